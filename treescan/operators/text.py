"""Source text: lines, search, comments and token classes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """file, line_no (1-based), line. Exactly one line break at the end is dropped before the text is split."""
    body = F.regexp_replace(F.col(text_col), r"(\r\n|\n|\r)\z", "")
    return texts.select(F.col(id_col).alias("file"), F.posexplode(F.split(body, "\n", -1)).alias("i", "line")).select("file", (F.col("i") + 1).alias("line_no"), "line")


#: Hits whose lengths are added up at once.
STEP = 128


def find_text(lines: DataFrame, term: str) -> DataFrame:
    """file, line_no, col (1-based) of every hit that does not overlap an earlier one; any case, a plain string.

    A hit starts after the pieces and hits before it: whole steps of STEP pieces are added up first, so the work for a
    line is not the square of its hits.
    """
    if not term.strip():
        return lines.select("file", "line_no", F.lit(1).alias("col")).where("false")
    pattern = r"(?iu)\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"
    pieces = F.split("line", pattern, -1)
    sizes = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))
    total = lambda of, start, n: F.aggregate(F.slice(of, start, n), F.lit(0), lambda a, b: a + b)
    # generators, so that lists are worked out once for a line and not for each of their elements
    found = lines.where(F.col("line").rlike(pattern)).select("file", "line_no", F.explode(F.array(sizes)).alias("sizes"))
    steps = F.transform(F.sequence(F.lit(0), ((F.size("sizes") - 1) / STEP).cast("int")), lambda k: total(F.col("sizes"), k * STEP + 1, F.lit(STEP)))
    found = found.select("file", "line_no", "sizes", F.explode(F.array(steps)).alias("steps"))
    step = lambda i: (i / STEP).cast("int")
    start = lambda _, i: total(F.col("steps"), F.lit(1), step(i)) + total(F.col("sizes"), step(i) * STEP + 1, i % STEP + 1) + i * len(term) + 1
    return found.select("file", "line_no", F.explode(F.transform("sizes", start)).alias("col"))


def find_next(cursors: DataFrame, hits: DataFrame, backward: bool = False) -> DataFrame:
    """cursors (cursor_id, file, line, col) to the first hit at or after each, else the first of the file (wrapped);
    backward the last hit before it, else the last of the file.

    Cursors and hits of a file are put in one order, so that each cursor takes the hit that it comes to last.
    """
    place = F.struct(F.col("line"), F.col("col"))
    rows = cursors.select("file", "cursor_id", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), F.lit(None).cast("struct<line: bigint, col: bigint>").alias("hit"))
    found = hits.select("file", F.lit(None).cast(cursors.schema["cursor_id"].dataType).alias("cursor_id"), F.col("line_no").cast("long").alias("line"), F.col("col").cast("long").alias("col")).withColumn("hit", place)
    of_file = Window.partitionBy("file")
    # at one place a hit comes before the cursor forward, and after it backward
    order = ["line", "col", F.col("hit").isNotNull()] if backward else [F.col("line").desc(), F.col("col").desc(), F.col("hit").isNull()]
    so_far = of_file.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.last("hit", ignorenulls=True).over(so_far)
    end = (F.max if backward else F.min)("hit").over(of_file)
    out = rows.union(found).select("cursor_id", near.alias("near"), end.alias("end")).where("cursor_id is not null and end is not null")
    best = F.coalesce("near", "end")
    return out.select("cursor_id", best["line"].alias("line_no"), best["col"].alias("col"), F.col("near").isNull().alias("wrapped"))


def comment_text(pieces: DataFrame) -> DataFrame:
    """pieces: comment_id, seq, text, ends_paragraph. Joined text: a space between pieces where neither side is white
    space; a line feed ends a paragraph unless there is one."""
    ordered = pieces.groupBy("comment_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"), "ends_paragraph"))).alias("parts"))

    def add(out: Column, p: Column) -> Column:
        blank = lambda c: c.rlike(r"^\s$")
        space = F.when((out != "") & (p["text"] != "") & ~blank(F.right(out, F.lit(1))) & ~blank(F.left(p["text"], F.lit(1))), " ").otherwise("")
        joined = F.concat(out, space, p["text"])
        return F.when(p["ends_paragraph"] & (joined != "") & (F.right(joined, F.lit(1)) != "\n"), F.concat(joined, F.lit("\n"))).otherwise(joined)

    return ordered.select("comment_id", F.aggregate("parts", F.lit(""), add).alias("text"))


# Keywords of the languages
KEYWORDS = (
    "alignas alignof asm auto bool break case catch char class const constexpr consteval constinit continue decltype default delete "
    "do double else enum explicit extern false float for friend goto if inline int long mutable namespace new noexcept nullptr "
    "operator private protected public register reinterpret_cast requires return short signed sizeof static static_assert struct "
    "switch template this thread_local throw true try typedef typename union unsigned using virtual void volatile while"
).split()


#: A comment, a literal, the start of a preprocessor line, or a word with the bracket after it, whichever comes first.
TOKEN = "|".join([r"/\*[\s\S]*?(?:\*/|\z)", r"//[^\n]*", r'"(?:\\[^\n]|[^"\\\n])*"?', r"'(?:\\[^\n]|[^'\\\n])*'?", r"(?:^|\n)[ \t]*#[ \t]*[A-Za-z0-9]*", r"[A-Za-z_][A-Za-z0-9_]*(?:[ \t]*\()?"])


def token_profile(texts: DataFrame, id_col: str, text_col: str, keywords: list[str] | None = None, not_functions: list[str] | None = None) -> DataFrame:
    """Counts per file: keywords, identifiers before '(', preprocessor lines, literals, comments.

    One pattern reads the text once, comments and literals first, so what they hold counts as nothing else. Block
    comments span lines; literals end with their line. Words that are no functions even before '(': not_functions.
    """
    keywords = KEYWORDS if keywords is None else keywords
    words = "|".join(map(re.escape, sorted(keywords, key=lambda w: (-len(w), w))))
    t = F.col("t")
    word = F.regexp_extract(t, r"^[A-Za-z_][A-Za-z0-9_]*", 0)
    call = t.rlike(r"^[A-Za-z_].*\($") & ~word.isin(list(not_functions if not_functions is not None else keywords))
    kind = F.when(t.rlike(r"^/[/*]"), "comment").when(t.rlike("^[\"']"), "literal").when(t.rlike(r"^\s*#"), "preprocessor").when(word.rlike(f"^(?:{words})$"), "keyword").when(call, "function")
    rows = texts.select(F.col(id_col).alias("file"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"({TOKEN})"), F.lit(0))).alias("t")).select("file", kind.alias("k")).where("k is not null")
    names = ["keyword", "function", "preprocessor", "literal", "comment"]
    return rows.groupBy("file").agg(*[F.count_if(F.col("k") == n).alias(f"n_{n}") for n in names])


def offsets(lines: DataFrame) -> DataFrame:
    """lines with the 0-based offset of each line's first character in its file."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
