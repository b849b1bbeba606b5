"""One query per operator over its whole table, with the results the contract names, and SQL where it can say them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import common, decontaminate, extract, fim, language, linededup, minhash, packing, periodic, quality, secret_scan, sharding, topk, toxicity

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def remainder(key: Column, folds: int) -> Column:
    """crc32 of a key as text, modulo the folds; null keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def fitted_toxicity(spark: SparkSession, documents: DataFrame, sf_dir: str) -> toxicity.Model:
    """A classifier from all labelled documents outside the held-out fold."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learned = documents.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "text")
    # Only texts that may have a label are shuffled, as a bitmap of fixed size tells.
    sub = F.xxhash64(F.col("doc_id").cast("long"))
    marks = common.bitmap(labels.select(F.shiftrightunsigned(sub, 64 - common.KEY_BITS).alias("pos")), common.KEY_BITS)
    _, maybe = common.split_rows(learned, marks, common.KEY_BITS, sub=sub)
    found = maybe.select("row.*").join(labels.hint("merge"), "doc_id")
    return toxicity.fit_all(found.select("doc_id", "text", F.col("toxic").alias("label")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = fitted_toxicity(spark, documents, sf_dir)
    scored = toxicity.score(documents, model, more={"held_out": remainder(documents["doc_id"], 5) == 0})
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    return topk.top_products(embeddings, embeddings["vec_id"] % 50 == 0)


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = extract.extract(pages, extract.fit(extract.training_pages(pages)))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_cut", "text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    learned = documents.where(remainder(F.col("doc_id"), 4) != 2)
    rows = common.labelled(learned, F.col("text"), F.col("lang"))
    model = language.fit(common.bounded_sample(rows, learned, language.SAMPLE_ROWS, language.SAMPLE_BYTES))
    found = language.identify(documents, model, more={"held_out": remainder(documents["doc_id"], 4) == 2})
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.clean(_table(spark, sf_dir, "documents"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select(*base, "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by crc32 of the id, with a tail of words repeated as the query's contract says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            drawn = [zlib.crc32(b"" if i is None else b"%d" % i) for i in ids]
            for top, end, data, offsets in common.slices(batch.column("text")):
                out = []
                for a, b, h in zip(offsets[:-1].tolist(), offsets[1:].tolist(), drawn[top:end], strict=True):
                    raw = data[a:b].tobytes()
                    if h % 10 == 0 and (words := raw.split()):
                        n, g = len(words), h // 10
                        first = g % n
                        period = 1 + (n - first) // (3 + g % 8)
                        tail = words[first : first + period]
                        raw = b" ".join(words[:first] + (tail * -(-(n - first) // period))[: n - first])
                    out.append(raw)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(top, end - top), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return common.texts(docs, "doc_id", "text").mapInArrow(run, "doc_id long, text string")


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periodic_tails(_table(spark, sf_dir, "documents")))
    # Ties go to the smallest start, then period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumn("longest", longest)
    longest = F.col("longest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-longest["start"]).alias("start"),
        longest["length"].alias("length"),
        (-longest["period"]).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_toxicity, op3_secrets, op4_packing, op5_topk, op6_extraction, op7_line_dedup, op8_decontamination, op9_language, op10_minhash)
    found += op11_quality, op12_periodic, op13_fill_in_middle
    return {f.__name__: f for f in found}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TOPK = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (
  SELECT rid, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

_MINHASH = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * common >= 85 * (p.n + q.n - common)
), linked AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT rid AS x, rid AS y FROM d UNION SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (rid)
JOIN (SELECT reach.x AS rid, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.rid = reach.y GROUP BY reach.x) c USING (rid)
"""

_PHRASES = "|".join(quality.PHRASES)
_MARKS = "[" + re.sub(r"([\]\[\\])", r"\\\1", quality.SENTENCE_MARKS).replace("'", "''") + "]"
_SEPARATORS = ", ".join(f"'{s}'" for s in quality.SEPARATORS)
_WORDS = r"'[^\x20\x09-\x0D]+'"

_QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents
), l AS (
  SELECT rid, i, line, regexp_extract_all(line, {_WORDS}) AS w, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS later
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)
), m AS (
  SELECT *, length(array_to_string(w, '')) AS chars,
    len(list_filter(w, lambda x: regexp_matches(x, '[!?]$'))) AS shouted, len(list_filter(w, lambda x: x IN ({_SEPARATORS}))) AS parted,
    length(line) - length(regexp_replace(line, '[{quality.SYMBOLS}]', '', 'g')) AS symbols
  FROM l WHERE len(w) > 0
), f AS (
  SELECT *, NOT regexp_matches(w[-1], '{_MARKS}$') AND chars < {quality.FRAGMENT} OR len(w) >= 5 AND 100 * shouted >= {quality.SHOUTED} * len(w) AS punctuation,
    parted >= 3 AND 100 * parted >= {quality.SEPARATED} * len(w) AS navigation,
    later OR 100 * symbols >= {quality.SYMBOLIC} * chars OR regexp_matches({_LOWER.format("line")}, '{_PHRASES}') AS boilerplate
  FROM m
), of_lines AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (later) AS n_dup_lines, count(*) FILTER (punctuation) AS n_punctuation,
    count(*) FILTER (navigation) AS n_navigation, count(*) FILTER (boilerplate) AS n_boilerplate,
    sum(chars) FILTER (punctuation OR navigation OR boilerplate) AS lost
  FROM f GROUP BY rid
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid
), a AS (
  SELECT rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[{quality.SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate,
  coalesce(lost, 0)::BIGINT AS lost_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT base_failed AND 100 * coalesce(lost, 0) <= {quality.LOST} * word_chars AS kept
FROM a LEFT JOIN of_lines USING (rid)
"""

_FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), c AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 AS plain,
    ('0x' || h[25:32])::BIGINT % 100 < 20 AS swapped
  FROM d
), p AS (
  SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN swapped THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(c1, c2)], '') AS a, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(u[greatest(c1, c2) + 1:n], '') AS z
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": _TOPK, "op8_decontamination": _DECONTAMINATION, "op10_minhash": _MINHASH, "op11_quality": _QUALITY, "op13_fill_in_middle": _FILL_IN_MIDDLE}
