"""The training-data operators as queries over the test tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read


def _held_out(n: int, rest: int) -> Column:
    return F.coalesce(crc_mod("doc_id", n) == rest, F.lit(False)).alias("held_out")


def _vocabulary() -> tuple[str, str]:
    vocabulary = importlib.import_module("public_tokenizers")
    return vocabulary.path("byte_bpe_50k.json"), vocabulary.path("byte_bpe_50k.tiktoken")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination, digest

    return digest(contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10, slop=5), near=True)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), *_vocabulary())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, toxicity

    docs = read(spark, sf_dir, "documents")
    learn = F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False))
    scored = toxicity(docs, fit(docs, read(spark, sf_dir, "labels"), learn))
    return scored.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations, first_of_each

    return first_of_each(collocations(read(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_packing, op8_toxicity, op10_near_duplicates)
}

ORACLE_SQL: dict[str, str] = {}

_WORDS1 = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op1_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS1.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS1.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, w[i:i+9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i+n-1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id),
-- all words of a window, in any order, within its length and five words more: looked for around its rarest word
dp AS (SELECT doc_id, w, i, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
freq AS (SELECT t, count(*) AS c FROM dp GROUP BY t),
wins AS (SELECT item_id, list_distinct(win) AS terms, len(win) + 5 AS span FROM bw),
rare AS (SELECT item_id, terms, span, min_by(freq.t, (c, freq.t)) AS t FROM (SELECT *, unnest(terms) AS t FROM wins) x JOIN freq ON freq.t = x.t GROUP BY ALL HAVING count(*) = len(terms)),
around AS (SELECT doc_id, item_id, terms, span, w[greatest(i - span + 1, 1):i + span - 1] AS part FROM rare JOIN dp USING (t)),
near AS (SELECT DISTINCT doc_id, item_id FROM (SELECT * FROM around WHERE list_has_all(part, terms)) WHERE len(list_filter(range(1, len(part) + 1), lambda s: list_has_all(part[s:s+span-1], terms))) > 0),
near_ids AS (SELECT doc_id, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS near_items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM near) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_ids USING (doc_id)
"""

#: All pairs of documents that share a shingle, then reachability: the plain definition, affordable at the test scale.
ORACLE_SQL["op10_near_duplicates"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common.c >= 85 * (nx.c + ny.c - common.c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, r.m AS component_id, r.m = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id
"""


#: Sizes, water level of the capped shares, and the nearest running sum by hash, by sorting.
ORACLE_SQL["op11_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS w FROM d GROUP BY source),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS t FROM s),
-- a level without the sources that fill up below it; the first that doesn't pass its own source's bound holds
level AS (SELECT 2.0 * a.source_size / a.w AS r, 150 * any_value(t) - 100 * coalesce(sum(2 * b.source_size) FILTER (2.0 * b.source_size / b.w < 2.0 * a.source_size / a.w), 0) AS num,
                 100 * sum(b.w) FILTER (2.0 * b.source_size / b.w >= 2.0 * a.source_size / a.w) AS den FROM s a, s b, total WHERE a.source_size > 0 GROUP BY a.source, a.source_size, a.w),
held AS (SELECT CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den FROM level WHERE num / den <= r ORDER BY r LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN source_size = 0 OR 2 * source_size * den < w * num THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target
      FROM s LEFT JOIN held ON TRUE),
w AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
p AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS size FROM d WHERE size > 0 GROUP BY source, h),
e AS (SELECT p.source, target - whole * source_size AS rest, min_by(h, upto) AS h, min(upto) AS upto, min_by(size, upto) AS size
      FROM p JOIN w ON p.source IS NOT DISTINCT FROM w.source WHERE upto > target - whole * source_size AND target - whole * source_size > 0 GROUP BY ALL),
l AS (SELECT source, h - CASE WHEN CAST(2 * upto - size AS DOUBLE) < 2 * rest THEN 0 ELSE 1 END AS lim FROM e)
SELECT d.doc_id, d.size, w.source_size, w.target, CAST(d.size * (w.whole + CASE WHEN d.h <= coalesce(l.lim, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN l ON d.source IS NOT DISTINCT FROM l.source
"""


#: Every phrase of every place, counted plainly.
ORACLE_SQL["op12_collocations"] = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, w[i:i+m-1] AS p FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 6) r(m) WHERE i + m - 1 <= len(w)) GROUP BY lang, p HAVING count(*) >= 100),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) >= 2),
cut AS (SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS score
        FROM (SELECT *, unnest(range(1, len(p))) AS k FROM c) c JOIN total USING (lang) JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k+1:]),
s AS (SELECT lang, p, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS b FROM cut GROUP BY ALL),
inner_p AS (SELECT lang, p[i:i+m-1] AS p, max(a) AS outer_a FROM (SELECT lang, p, a, unnest(range(1, len(p) + 1)) AS i FROM c), range(2, 5) r(m) WHERE i + m - 1 <= len(p) AND m < len(p) GROUP BY ALL),
k AS (SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.b.l, s.b.r, n, s.b.score FROM s JOIN total USING (lang) LEFT JOIN inner_p i ON i.lang = s.lang AND i.p = s.p WHERE coalesce(outer_a, 0) < s.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) WHERE rank <= 2000
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses

    return derivatives(responses(read(spark, sf_dir, "pages")), keep=["page_id"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    learn = F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))
    scored = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest as spans_digest
    from .pii import personal_data

    return spans_digest(personal_data(read(spark, sf_dir, "documents")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_main_text

    return extract_main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    found = languages(read(spark, sf_dir, "documents"), crc_mod("doc_id", 3) != 1)
    return found.select("doc_id", _held_out(3, 1), "lang_pred", "score")


_LATER = (op11_mixing, op12_collocations, op13_whitening, op3_warc, op4_quality, op5_personal_data, op6_quality_rules, op7_html_text, op9_language)
QUERIES = {f.__name__: f for f in sorted((*QUERIES.values(), *_LATER), key=lambda f: int(f.__name__[2:].split("_")[0]))}


def _warc_sql() -> str:
    from .warc import BREAKS, DATE, DROPPED, LANGUAGE, LINKS, REFERENCES, TAGS, TITLE

    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def urn(key: str) -> str:
        return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({key}) AS h))"

    def decoded(x: str) -> str:
        for name, char in REFERENCES:
            x = f"replace({x}, {quoted(name)}, {quoted(char)})"
        return x

    crlf = "chr(13) || chr(10)"
    text = f"regexp_replace(payload, {quoted(DROPPED)}, '', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '[ \\t\\r\\n\\f]+', ' ', 'g'), {quoted(BREAKS)}, chr(10), 'g')"
    text = decoded(f"regexp_replace({text}, {quoted(TAGS)}, '', 'g')")
    text = f"regexp_replace(regexp_replace({text}, '[ ]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    text = f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    title = f"trim(regexp_replace({decoded(f'regexp_extract(payload, {quoted(TITLE)}, 1)')}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
    links = f"regexp_extract_all(payload, {quoted(LINKS)}, 1)"
    fields = (
        f"'title: ' || {title} || {crlf} || 'language: ' || regexp_extract(payload, {quoted(LANGUAGE)}, 1) || {crlf} || 'payload-length: ' || strlen(payload) || {crlf}"
        f" || 'payload-digest: ' || source_payload_digest || {crlf} || 'outlinks: ' || len({links})"
        f" || array_to_string(list_transform({links}, lambda u: {crlf} || 'outlink: ' || u), '') || {crlf}"
    )
    return f"""
WITH r AS (SELECT page_id, {urn("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || sha1(coalesce(html, ''))")} AS refers_to, url AS target_uri, '{DATE}' AS warc_date, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload) AS source_headers FROM r),
s AS (SELECT *, 'sha1:' || sha1(payload) AS source_payload_digest, 'sha1:' || sha1(source_headers || {crlf} || {crlf} || payload) AS source_block_digest FROM h),
c AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {fields} AS content FROM s
      UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM s)
SELECT page_id, refers_to, target_uri, warc_date, source_headers, source_payload_digest, source_block_digest, record_type, content_type, content,
       {urn("record_type || '|' || refers_to")} AS record_id, CAST(strlen(content) AS BIGINT) AS content_length, 'sha1:' || sha1(content) AS block_digest
FROM c
"""


ORACLE_SQL["op3_warc"] = _warc_sql()
