"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm import decontamination, embeddings, jaccard, licences, mixing, pitman_yor, repeats, rollups, runs, spelling, tokens, toxicity, warc
from meterwise.llm.common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    archives = warc.write_archives(warc.chunk_rows(warc.records(pages)))
    read = warc.record_table(warc.read_archives(spark, archives, payloads=False))
    kind = pages.schema["page_id"].dataType
    return read.withColumns({c: F.nullif(F.col(c), F.lit("")).cast(kind) for c in ("record_id", "refers_to")}).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN keeper IS NULL OR page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper IS NULL OR page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to
FROM k
"""


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(_table(spark, sf_dir, "documents"), tokenizer_file())


def op3_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, mixing.root_weights(docs))


OP3_SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, CAST(round(sqrt(count(*)) * 1000) AS BIGINT) AS weight FROM documents GROUP BY source
), rates AS (
  SELECT source, weight / CAST((SELECT sum(weight) FROM counts) AS DOUBLE) * CAST((SELECT sum(n) FROM counts) AS DOUBLE) / n AS mean
  FROM counts
), split AS (
  SELECT source, greatest(CAST(ceil(mean / 16.0) AS INT), 1) AS parts, mean / greatest(CAST(ceil(mean / 16.0) AS INT), 1) AS m
  FROM rates
), chances AS (
  SELECT source, parts, m, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM split
  UNION ALL
  SELECT source, parts, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM chances WHERE k < 96
), lists AS (
  SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS chances FROM chances GROUP BY source
), drawn AS (
  SELECT d.*, list_sum([len([c FOR c IN chances IF c <=
    CAST(('0x' || substr(md5('mixture:' || part || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
      / 4503599627370496.0]) FOR part IN range(1, parts + 1)]) AS copies
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
), repeated AS (
  SELECT * EXCLUDE (copies), CAST(unnest(range(1, CAST(copies AS BIGINT) + 1)) AS INT) AS copy FROM drawn WHERE copies > 0
)
SELECT *, CAST(('0x' || substr(md5('mixture:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy), 1, 15)) AS BIGINT) AS shuffle_key
FROM repeated
"""


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    judged = decontamination.contamination(docs.select("doc_id", "text"), items)
    return judged.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.col("__hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("__hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), hits AS (SELECT DISTINCT doc_id, w.n, i, item_id FROM windows w JOIN grams g ON w.g = g.g AND w.n = g.n),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.shingle_components(_table(spark, sf_dir, "documents"))


def op7_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under both tokenizer versions; then texts with an at sign are counted anew without the runs that have one,
    and documents that repeat the text of a smaller one are deleted. The second batch is sent twice."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    state = rollups.TokenRollup(spark, scratch(spark, "rollup"))
    text = F.col("text")
    state.commit("first count", rollups.changes(docs, "insert", "runs-1", rollups.counted(text, "runs-1")))
    second = rollups.changes(docs, "insert", "words-2", rollups.counted(text, "words-2"))
    state.commit("second tokenizer", second)
    state.commit("second tokenizer", second)
    marked = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*")), F.lit(0))
    revised = docs.where(F.contains(text, F.lit("@")))
    again = rollups.changes(revised, "revise", "runs-1", rollups.counted(text, "runs-1") - marked)
    first = docs.where("text is not null").groupBy(F.sha2(text, 256).alias("digest")).agg(F.min("doc_id").alias("first"))
    copies = docs.where("text is not null").select("doc_id", "source", "lang", F.sha2(text, 256).alias("digest"))
    copies = copies.join(first, "digest").where("doc_id > first")
    state.commit("recount and removal", again.unionByName(rollups.changes(copies, "delete", None, None)))
    return state.totals()


OP8_SQL = r"""
WITH d AS (
  SELECT source, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy, text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS runs,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*')) AS marked,
    len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS words
  FROM documents
), kept AS (SELECT * FROM d WHERE text IS NULL OR copy = 1)
SELECT source, lang, 'runs-1' AS version, count(*) AS documents, CAST(sum(runs - marked) AS BIGINT) AS tokens FROM kept GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words-2', count(*), CAST(sum(words) AS BIGINT) FROM kept GROUP BY source, lang
"""


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    """The same steps in another engine's patterns, which look neither back nor ahead: line breaks are doubled, so that each
    sentence takes one on either side and leaves one to its neighbour."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    by_text = {licences.normal(s): name for name, s in licences.SENTENCES.items()}
    known = ", ".join(f"({quoted(s)}, {quoted(name)})" for s, name in by_text.items())
    gap = r"(?: |\n\n)"
    wrapped = "|".join(s.replace(" ", gap).replace(f"{gap}http{gap}", rf"{gap}(?:\n\n)?http{gap}") for s in licences.longest_first(by_text))
    rules = ", ".join(
        f"({i}, {quoted(name)}, {quoted(licence)}, {quoted('%' + ''.join('%' if x == '*' else f'<{x}>' for x in sequence) + '%')})"
        for i, (name, licence, sequence) in enumerate(licences.RULES)
    )
    return rf"""
WITH known(s, name) AS (VALUES {known}), rules(n, rule, licence, pattern) AS (VALUES {rules}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.!?][ \t\r\n]+', chr(10) || chr(10), 'g') AS t
  FROM documents
), lined AS (
  SELECT r, doc_id, regexp_replace(regexp_replace(t, '[^a-z0-9\r\n]+', ' ', 'g'),
    '(?:^ ?| ?(?:\r\n?|\n) ?)(?:(?:dnl|rem)\b ?)?', chr(10), 'g') AS t FROM texts
), parts AS (
  SELECT r, unnest(p) AS part, generate_subscripts(p, 1) AS i
  FROM (SELECT r, regexp_extract_all(replace(t, chr(10), chr(10) || chr(10)), '\n(?:{wrapped})(?:\n| ?\z)') AS p FROM lined)
), found AS (
  SELECT r, string_agg('<' || name || '>', '' ORDER BY i) AS ids, count(*) AS n
  FROM parts JOIN known ON s = trim(regexp_replace(part, '\n+', ' ', 'g')) GROUP BY r
), matched AS (
  SELECT r, min_by(rule, m.n) AS rule, min_by(licence, m.n) AS licence FROM found f, rules m WHERE f.ids LIKE m.pattern GROUP BY r
), each AS (
  SELECT r, licence, min(m.n) AS n FROM found f, rules m WHERE f.ids LIKE m.pattern GROUP BY r, licence
), lists AS (SELECT r, string_agg(licence, ',' ORDER BY n) AS licences FROM each GROUP BY r)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(n, 0) AS n_sentences, rule, licence, coalesce(licences, '') AS licences
FROM texts LEFT JOIN found USING (r) LEFT JOIN matched USING (r) LEFT JOIN lists USING (r)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents under the averaged seatings, and under counts of single words."""
    return pitman_yor.score(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some runs short of a letter, with the near word of largest count and where such words lead."""
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), lose=31))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in all documents, a tenth of which get a repeating tail first, and the digest of what stays without them."""
    docs = _table(spark, sf_dir, "documents")
    found = runs.periodic_runs(docs.select("doc_id", runs.planted().alias("text")))
    # The longest run, the earliest of equal ones, then the one of the smallest period.
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.n").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.floor(F.col("top.n") * 1000 / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_chunks": op1_warc_chunks,
        "op2_token_index": op2_token_index,
        "op3_poisson_mixture": op3_poisson_mixture,
        "op4_repeated_bytes": op4_repeated_bytes,
        "op5_decontamination": op5_decontamination,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_near_embeddings": op7_near_embeddings,
        "op8_token_rollup": op8_token_rollup,
        "op9_licence_scan": op9_licence_scan,
        "op10_toxicity": op10_toxicity,
        "op11_pitman_yor": op11_pitman_yor,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_chunks": OP1_SQL,
        "op3_poisson_mixture": OP3_SQL,
        "op5_decontamination": OP5_SQL,
        "op8_token_rollup": OP8_SQL,
        "op9_licence_scan": _op9_sql(),
    }
