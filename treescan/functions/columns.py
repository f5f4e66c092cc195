"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of source files, level names, labels of enumerations
SOURCE_PATTERN = r"(?i)\.(cpp|cc|cxx|c|m|mm)$"
LEVELS = {"info": "Info", "fatal": "Error", "error": "Error", "warning": "Warning", "warn": "Warning", "debug": "Debug", "note": "Debug", "remark": "Debug"}
LABELS = {
    "valueKind": {0: "VK_PRValue", 1: "VK_LValue", 2: "VK_XValue"},
    "objectKind": {0: "OK_Ordinary", 1: "OK_BitField", 2: "OK_VectorComponent", 3: "OK_ObjCProperty", 4: "OK_ObjCSubscript", 5: "OK_MatrixComponent"},
    "initStyle": {0: "CInit", 1: "CallInit", 2: "ListInit", 3: "ParenListInit"},
    "storageClass": {0: "SC_None", 1: "SC_Extern", 2: "SC_Static", 3: "SC_PrivateExtern", 4: "SC_Auto", 5: "SC_Register"},
    "linkage": {0: "Invalid", 1: "None", 2: "Internal", 3: "UniqueExternal", 4: "VisibleNone", 5: "Module", 6: "External"},
}
UNKNOWN_LABEL = {"valueKind": "VK_Unknown", "objectKind": "OK_Unknown", "initStyle": "InitStyle_Unknown", "storageClass": "SC_Unknown", "linkage": "Unknown"}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize_field(c: str | Column) -> Column:
    """Line feeds, carriage returns and tabs become blanks, one for one."""
    return F.translate(col(c), "\n\r\t", "   ")


def format_diag(level: Column, file: Column, line: Column, column: Column, message: Column) -> Column:
    """The wire line of a diagnostic; line and column are blank unless positive."""
    number = lambda n: F.when(n > 0, n.cast("string")).otherwise("")
    text = lambda c: F.coalesce(sanitize_field(c), F.lit(""))
    return F.concat_ws("\t", F.lit("@diag"), level, text(file), number(line), number(column), text(message))


def level_of(c: str | Column) -> Column:
    """Level of a level's name; Info where it is unknown."""
    name = F.lower(F.trim(col(c)))
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in LEVELS.items()], F.lit("Info"))


def guess_level(line: Column, is_stderr: Column) -> Column:
    """Level of an unstructured line by the first kind of word in it; default by stream."""
    has = lambda words: F.lower(line).rlike(rf"(^|[^\p{{L}}\p{{N}}_])({words})($|[\s:\]),;]|\.$)")
    return F.when(has("fatal|error"), "Error").when(has("warning|warn"), "Warning").when(has("note|remark|debug"), "Debug").when(is_stderr, "Warning").otherwise("Info")


def normalize_path(c: str | Column) -> Column:
    """Lexical normal form: one kind of separator, no '.', no 'x/..'; a leading '//' stays, '..' above the root goes."""
    p = F.translate(col(c), "\\", "/")
    absolute = p.startswith("/")
    lead = F.when(p.startswith("//") & ~p.startswith("///"), "//").when(absolute, "/").otherwise("")

    def step(parts: Column, x: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        up = F.when(last.isNotNull() & (last != ".."), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).when(absolute, parts).otherwise(F.concat(parts, F.array(x)))
        return F.when(x.isin("", "."), parts).when(x == "..", up).otherwise(F.concat(parts, F.array(x)))

    body = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    full = F.concat(lead, body)
    return F.when(p == "", "").when(full == "", ".").otherwise(full)


def is_under_root(path: Column, root: Column) -> Column:
    """Whether a path is the root or below it; false for an empty root."""
    return F.coalesce((root != "") & ((path == root) | path.startswith(F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))), F.lit(False))


def display_path(path: Column, root: Column) -> Column:
    inside = (root != "") & path.startswith(F.concat(root, F.lit("/")))
    return F.when(inside, F.concat(F.lit("[project] "), F.substr(path, F.length(root) + 2))).otherwise(F.concat(F.lit("[external] "), path))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def project_key(path: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a path."""
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


def export_name(kind: Column, name: Column) -> Column:
    """File name of an exported subtree."""
    kind, name = F.coalesce(kind, F.lit("")), F.coalesce(name, F.lit(""))
    base = F.when(name == "", kind).otherwise(F.concat(kind, F.lit("_"), name))
    safe = F.regexp_replace(base, r"_?[^\p{L}\p{N}_-]+", "_")
    return F.concat(F.when(safe == "", F.lit("ast_subtree")).otherwise(safe), F.lit(".json"))


def scalar_to_string(value: Column, kind: Column) -> Column:
    """Text of a scalar variant of the type ``kind`` (schema_of_variant); '' for arrays, objects and null."""
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(F.when(kind.isin("STRING", "BOOLEAN", "BIGINT"), text).when((kind == "DOUBLE") | kind.startswith("DECIMAL"), format_general(number)), F.lit(""))


def format_general(x: Column) -> Column:
    """A double with 6 significant digits: plain for exponents from -4 to 5, else in scientific notation."""
    science = F.format_string("%.5e", x)
    exponent = F.regexp_extract(science, r"e([+-]\d+)$", 1).cast("int")
    short = F.concat(F.regexp_replace(F.regexp_extract(science, r"^(.*)e", 1), r"\.?0*$", ""), F.regexp_extract(science, r"(e[+-]\d+)$", 1))
    rounded = science.cast("decimal(38,18)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, "0").when(exponent.between(-4, 5), plain).otherwise(short)


def range_size(begin_line: Column, begin_col: Column, end_line: Column, end_col: Column) -> Column:
    """Size of a range for comparison: lines first, then columns where it is on one line."""
    lines = (end_line - begin_line).cast("long")
    return F.struct(lines.alias("lines"), F.when(lines == 0, (end_col - begin_col).cast("long")).otherwise(F.lit(0).cast("long")).alias("cols"))


def pos_key(line: Column, column: Column) -> Column:
    """Position as one number: lines of at most 2^20 columns."""
    return (line.cast("long") * (1 << 20) + column).cast("long")


def enum_label(code: Column, domain: str) -> Column:
    pairs = [F.lit(x) for k, v in LABELS[domain].items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit(UNKNOWN_LABEL[domain]))


def format_log_line(ts: Column, level: Column, source: Column, message: Column) -> Column:
    name = F.when(F.coalesce(F.trim(source), F.lit("")) == "", F.lit("treescan")).otherwise(source)
    return F.format_string("[%s] [%s] [%s] %s", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.upper(level), name, message)


def valid_location(file: Column, line: Column, column: Column) -> Column:
    return F.coalesce((file > 0) & (line > 0) & (column > 0), F.lit(False))
