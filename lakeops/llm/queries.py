"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import read_table

from . import decontaminate, divergence, exact, lines, neardup, packing, pieces, pii, quality, resample, secret_scan, shards, substring


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens by minimum bin slack."""
    p = packing.pack(read_table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents taken out of all documents."""
    out = lines.drop_frequent_lines(read_table(spark, sf_dir, "documents"), min_docs=10, min_points=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return decontaminate.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts, in a seeded random order."""
    out = shards.write_shards(read_table(spark, sf_dir, "documents"), n_shards=16)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: four-word shingles, similarity 0.8."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all documents, judged by a random forest; the finding itself is given as a hash."""
    out = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "end", F.sha2("finding", 256).alias("finding_sha256"), "score", "is_secret")


def held_out(doc_id):
    """Rows whose labels are kept from every fit: crc32 of the id as text leaves 2 on division by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    labels = read_table(spark, sf_dir, "labels")
    return quality.train(docs, labels.filter("quality = 1").select("doc_id"), exclude=held_out)


#: Documents with at least this score count as good.
GOOD = 0.7


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a positive-unlabelled classifier of labels.quality."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality_model(spark, docs, sf_dir)
    out = quality.score(docs.select("doc_id", "text"), model[0] if model else None)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 35 words that repeat anywhere taken out of all documents."""
    out = substring.remove_repeats(read_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact classes of all documents by their text without white space."""
    return exact.exact_groups(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: the counts and the digest are of the rules' spans, spans has all."""
    docs = read_table(spark, sf_dir, "documents")
    out = pii.find_pii(docs, pii.fit(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that set each source off."""
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents drawn by their likeness to the benchmark's texts."""
    return resample.importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the public 32k SentencePiece model."""
    return pieces.encode_pieces(read_table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii": op10_pii,
    "op11_source_divergence": op11_source_divergence,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLES = {
    "op12_importance_resampling": r"""
        WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1)
                                                                                     ELSE c >> 1 END) ORDER BY i) AS t
                     FROM range(256) r(i)),
             d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
             b AS (SELECT unnest(regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
             w AS (SELECT r, unnest(words) AS word FROM d),
             x AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM w UNION SELECT word FROM b)),
             v AS (SELECT word, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM x),
             k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)),
                                    4294967295) % 10000 AS bucket FROM v, crc),
             s AS (SELECT bucket, count(*) AS s FROM w JOIN k USING (word) GROUP BY bucket),
             t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
             n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
             g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000)))) AS gain
                   FROM s LEFT JOIN t USING (bucket), n),
             z AS (SELECT r, sum(gain) AS weight FROM w JOIN k USING (word) JOIN g USING (bucket) GROUP BY r),
             o AS (SELECT d.doc_id, len(words) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                          CAST('0x' || sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[:8] AS BIGINT) AS h
                   FROM d LEFT JOIN z USING (r)),
             e AS (SELECT doc_id, n_features, weight,
                          weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM o),
             f AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS pos,
                          count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM e)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
               CASE WHEN n_features >= 20 AND pos <= n * 10 // 100 THEN CAST(pos AS BIGINT) END AS rank FROM f""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
             w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
             kept AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
             c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
             g AS (SELECT DISTINCT lang, source FROM d),
             lt AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM kept GROUP BY lang),
             gt AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
             p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                          1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gt.total, 0) + 2 * lt.v)::HUGEINT AS p,
                          1 + (1000000000::HUGEINT * (k.ln + 2)) // (lt.total + 2 * lt.v)::HUGEINT AS q
                   FROM g JOIN kept k USING (lang) JOIN lt USING (lang) LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source
                   LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             pr AS (SELECT a.lang, a.source, b.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
                    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
                    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
                    GROUP BY ALL),
             tm AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
             u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pr
                   UNION ALL SELECT lang, source, 'term', item, value FROM tm),
             k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM k WHERE part = 'pair' OR rank <= 10""",
    "op2_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
             k AS (SELECT doc_id, pos, line,
                          trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
             f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
             m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x,
                          translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS k
                   FROM documents),
             r AS (SELECT doc_id, k,
                          first_value(doc_id) OVER (PARTITION BY k ORDER BY length(x) DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY k) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM r""",
}
