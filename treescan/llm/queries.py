"""The registered queries of the corpus operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treescan.llm import bpe, exact_dedup, importance, merkle, mixing, near_dedup, ngram_join, quality_rules, sharding, spelling, suffix_tree, toxicity, url_reputation
from treescan.llm.common import UPPER, crc_of_id, materialize, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    q = F.col(judged.columns[-1])
    return judged.select("doc_id", *[q[c].alias(c) for c in (*quality_rules.STATS[:5], "base_failed", "kept", "rule")])


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_near_copies(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return coded.select("doc_id", F.col(f"{coded.columns[-1]}.*"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return sampled.select("doc_id", F.col(f"{sampled.columns[-1]}.*"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    t = F.col(scored.columns[-1])
    return scored.select("doc_id", (~toxicity.in_training("doc_id")).alias("held_out"), t["score"].alias("score"), t["predicted"].alias("predicted"), t["nearest"].alias("nearest"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host and bad of each page. A page shows the document whose id is the number in its path; it is bad where that
    document is labelled of low quality, and not labelled where the document isn't, or where there is no such number or
    one too long for an id."""
    pages = table(spark, sf_dir, "pages").select(url_reputation.host_of(F.col("url")).alias("host"), F.regexp_extract(url_reputation.path_of(F.col("url")), r"^/[^/]*/([0-9]+)", 1).try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    return pages.join(labels, "doc_id", "left").select("host", "bad")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh as the square root of their rows."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), mixing.tempered)
    return mixed.select("doc_id", "source", F.col(f"{mixed.columns[-1]}.*"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.find_links(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all fields, held against texts that are lower-cased for the ids whose crc32 3 divides."""
    lowered = F.translate("text", UPPER.decode(), UPPER.decode().lower())
    text = F.when(F.col("doc_id").isNotNull() & (crc_of_id("doc_id") % 3 == 0), lowered).otherwise(F.col("text"))
    proofs = merkle.proofs(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], told={"text": text})
    root = merkle.folded(F.col("told"), F.col("steps"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialize(spelling.vocabulary(table(spark, sf_dir, "documents")), "vocabulary")
    return spelling.group_variants(words)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_minhash_near_dedup, op3_sharding, op4_exact_dedup, op5_lm_scoring, op6_byte_level_bpe, op7_quality_classifier, op8_toxicity, op9_url_filters, op10_mixing, op11_ngram_jaccard_join, op12_merkle_manifest, op13_spelling_variants)
}

OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
h AS (SELECT doc_id, sha256(n) AS text_sha256 FROM t)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT p.host, l.bad FROM p LEFT JOIN l ON l.doc_id = TRY_CAST(nullif(regexp_extract(p.path, '^/[^/]*/([0-9]+)', 1), '') AS BIGINT)),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS name FROM o GROUP BY host),
h1s AS (SELECT *, regexp_matches(name, '^([0-9]+[.]){3}[0-9]+$|^\[.*\]$') AS address, coalesce(nullif(regexp_extract(name, '(^|[.])((ac|co|com|edu|gov|net|org)[.][a-z][a-z])$', 2), ''), regexp_extract(name, '[^.]*$', 0)) AS last FROM h0),
h AS (SELECT host, n, bad, CASE WHEN address THEN name WHEN length(name) <= length(last) THEN last ELSE regexp_extract(left(name, length(name) - length(last) - 1), '[^.]*$', 0) || '.' || last END AS domain, CASE WHEN address THEN name ELSE last END AS suffix FROM h1s),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
s AS (SELECT suffix, n, bad, (sum(bad) OVER () * 1.0::DOUBLE) / sum(n) OVER () AS m FROM s0),
ks AS (SELECT 1 / least(greatest(coalesce((sum((bad - n * m) ** 2 / n) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0), 0.0001), 0.5) - 1 AS k FROM s WHERE n > 0),
d1 AS (SELECT d.domain, d.n, d.bad, (ks.k * s.m + s.bad) / (ks.k + s.n) AS m FROM d JOIN s USING (suffix), ks),
kd AS (SELECT 1 / least(greatest(coalesce((sum((bad - n * m) ** 2 / n) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0), 0.0001), 0.5) - 1 AS k FROM d1 WHERE n > 0),
h1 AS (SELECT h.host, h.n, h.bad, (kd.k * d1.m + d1.bad) / (kd.k + d1.n) AS m FROM h JOIN d1 USING (domain), kd),
kh AS (SELECT 1 / least(greatest(coalesce((sum((bad - n * m) ** 2 / n) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0), 0.0001), 0.5) - 1 AS k FROM h1 WHERE n > 0),
r AS (SELECT h1.host, (kh.k * h1.m + h1.bad) / (kh.k + h1.n) AS rate, kh.k + h1.n + 1 AS strength FROM h1, kh),
v AS (SELECT p.page_id, p.host, p.path, CASE
    WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(p.path, '/en/') THEN 'example.net/en/'
    WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(p.path, '/de/') THEN 'example.com/de/'
    WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(p.path, '/fr/') THEN 'org/fr/'
    WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(p.path, '/') THEN 'net/' END AS rule,
    r.rate - 1.645 * sqrt(r.rate * (1 - r.rate) / r.strength) > 0.2 AS blocked
    FROM p LEFT JOIN r ON p.host = r.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict FROM v
"""

#: Components of documents by distinct shingles of {k} words; a link is 100 * intersection >= 85 * union.
_LINKS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 85 * (x.n + y.n - p.k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT doc_id, min(reach) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id{more} FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
OP2_SQL = _LINKS.format(k=5, more=", coalesce(c.least, d.doc_id) = d.doc_id AS kept")
OP11_SQL = _LINKS.format(k=4, more="")

#: crc32 of a list of bytes: a bit at a time.
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], {bytes}), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, o: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"
CRC_OF_ID = CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '-') AS tree, CASE WHEN {CRC_OF_ID} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS said FROM documents),
l AS (SELECT doc_id, tree, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="said")} AS told FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM l),
v AS (SELECT tree, 0 AS level, pos, size, leaf AS h FROM n UNION ALL SELECT tree, level + 1, pos // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM v WHERE size > 1 GROUP BY tree, level, pos // 8, size),
s AS (SELECT tree, level AS height, h, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS size FROM v WHERE size = 1),
u AS (SELECT 0 AS level, rank AS pos, size, h FROM s UNION ALL SELECT level + 1, pos // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE size > 1 GROUP BY level, pos // 8, size),
steps AS (
    SELECT n.tree, n.pos, v.level, coalesce(string_agg(v.h, '' ORDER BY v.pos) FILTER (v.pos < n.pos // (8 ** v.level)::BIGINT), '') AS l, coalesce(string_agg(v.h, '' ORDER BY v.pos) FILTER (v.pos > n.pos // (8 ** v.level)::BIGINT), '') AS r
    FROM n JOIN v ON v.tree = n.tree AND v.size > 1 AND v.pos // 8 = n.pos // ((8 ** (v.level + 1))::BIGINT) GROUP BY n.tree, n.pos, v.level
    UNION ALL
    SELECT n.tree, n.pos, s.height + u.level, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < s.rank // (8 ** u.level)::BIGINT), ''), coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > s.rank // (8 ** u.level)::BIGINT), '')
    FROM n JOIN s ON s.tree = n.tree JOIN u ON u.size > 1 AND u.pos // 8 = s.rank // ((8 ** (u.level + 1))::BIGINT) GROUP BY n.tree, n.pos, s.height, u.level),
p AS (SELECT tree, pos, string_agg(l || r, '' ORDER BY level) AS proof, list(struct_pack(l := l, r := r) ORDER BY level) AS steps FROM steps GROUP BY tree, pos),
f AS (SELECT n.tree, n.pos, 0 AS k, n.told AS h, p.steps FROM n LEFT JOIN p ON p.tree = n.tree AND p.pos = n.pos UNION ALL SELECT tree, pos, k + 1, sha256(steps[k + 1].l || h || steps[k + 1].r), steps FROM f WHERE k < len(steps)),
e AS (SELECT tree, pos, arg_max(h, k) AS folded_root FROM f GROUP BY tree, pos)
SELECT n.doc_id, n.leaf, s.h AS subroot, u.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = u.h AS verified
FROM n JOIN s ON s.tree = n.tree JOIN u ON u.size = 1 JOIN e ON e.tree = n.tree AND e.pos = n.pos LEFT JOIN p ON p.tree = n.tree AND p.pos = n.pos
"""

_BYTES = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + ord(x) // 64, 128 + ord(x) % 64]::BIGINT[] END))"

OP13_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, {CRC.format(bytes=_BYTES)} AS h FROM o),
m AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
c AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM c),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
    UNION ALL SELECT DISTINCT d.word, d.n, w.word, w.n FROM d JOIN w ON d.rest = w.word
    UNION ALL SELECT DISTINCT w.word, w.n, d.word, d.n FROM d JOIN w ON d.rest = w.word),
k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.near_n >= 10 * w.n THEN k.near END AS form, CASE WHEN k.near_n >= 10 * w.n THEN k.near_n END AS form_n FROM w LEFT JOIN k ON k.word = w.word AND k.place = 1),
u AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT u.word, f.word, f.form FROM u JOIN f ON f.word = u.up)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM f JOIN u ON u.word = f.word AND u.up IS NULL
"""

#: DuckDB SQL with the same rows, where SQL can express the operator.
ORACLES: dict[str, str] = {"op2_minhash_near_dedup": OP2_SQL, "op11_ngram_jaccard_join": OP11_SQL, "op4_exact_dedup": OP4_SQL, "op9_url_filters": OP9_SQL, "op12_merkle_manifest": OP12_SQL, "op13_spelling_variants": OP13_SQL}
