"""The subpackage's registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platehouse.llm import importance, infill, jaccard, mixing, packing, repetition, sharding, syncmers, toxicity, vectorfit, vptree, warc, wavelet
from platehouse.llm.shared import documents
from platehouse.llm.tokens import vocabulary

END_ID = 2


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and crc32 in wavelet-matrix files; see wavelet.write_shards."""
    return wavelet.read_shards(wavelet.write_shards(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), END_ID))


def wavelet_token_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of the first 64 ids occurs in all documents, in how many shards, counted by rank in op1's files."""
    shards = wavelet.write_shards(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), END_ID)
    found = wavelet.occurrences(shards, list(range(64)))
    return found.groupBy("token_id").agg(F.sum("n").alias("n"), F.count("*").alias("shards"))


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the repetition rules for every document; see repetition.score."""
    return repetition.score(documents(spark, sf_dir))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component of near-duplicates; see jaccard.near_duplicates."""
    return jaccard.near_duplicates(documents(spark, sf_dir))


def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op3 with every link found, inside components too: each document's set and number of links."""
    return jaccard.linked(documents(spark, sf_dir))[0]


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derived records of every page's response, by digest; see warc.derive."""
    return warc.digests(warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log ratio, Gumbel key, place and choice; see importance.resample."""
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a lexicon learned on rows that are not held out; see toxicity.score."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot among 24; see sharding.shard."""
    return sharding.shard(documents(spark, sf_dir))


def op8_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; see mixing.plan."""
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "epochs", "part_words")


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text and their likeness; see syncmers.fingerprint_edits."""
    return syncmers.fingerprint_edits(documents(spark, sf_dir))


def op10_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the packed sequences; see packing.pack."""
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), END_ID)


def op11_relational_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cuts and digests in fill-in-middle form; see infill.transform."""
    return infill.digests(infill.transform(documents(spark, sf_dir)))


def op12_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's sequence and place, in as few sequences as best fit finds; see vectorfit.pack."""
    return vectorfit.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), END_ID)


def op13_vptree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; see vptree.mine."""
    return vptree.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_wavelet_shards, wavelet_token_occurrences, op2_repetition_coverage, op3_jaccard_join, jaccard_links, op4_warc_derivatives, op5_importance_resampling, op6_toxicity, op7_minimax_shards, op8_water_filling, op9_syncmer_fingerprints, op10_hierarchical_packing, op11_relational_infill, op12_vector_best_fit, op13_vptree_negatives)
    return {f.__name__: f for f in found}


_WORD = r"[^\x20\x09-\x0D]+"


def _repetition_sql() -> str:
    """The counts and verdict of op2: words and lines unnested, windows of words as joined texts."""
    grams = sorted(repetition.MOST_IN_NGRAMS)
    texts = [f"CASE WHEN pos + {n - 1} <= last THEN string_agg(word, ' ') OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS g{n}" for n in (3, *grams)]
    twice = ["g3 IS NOT NULL AND count(*) OVER (PARTITION BY k, g3) > 1 AS d3", *[f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY k, g{n} ORDER BY pos) > 1 AS d{n}" for n in grams]]
    covered = [f"bool_or(d{n}) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in (3, *grams)]
    sums = [f"coalesce(sum(length(word)) FILTER (c{n}), 0)::BIGINT AS dup_{n}gram_chars" for n in grams]
    worse = " OR ".join(f"dup_{n}gram_chars > {m}::DOUBLE * greatest(word_chars, 1)" for n, m in repetition.MOST_IN_NGRAMS.items())
    names = ["n_words", "word_chars", "n_repeat_words", *(f"dup_{n}gram_chars" for n in grams)]
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT k, regexp_extract_all(text, '{_WORD}') AS words FROM d),
w AS (SELECT k, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos, len(words) AS last FROM l),
g AS (SELECT *, {", ".join(texts)} FROM w), t AS (SELECT *, {", ".join(twice)} FROM g), c AS (SELECT *, {", ".join(covered)} FROM t),
m AS (SELECT k, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {", ".join(sums)} FROM c GROUP BY k),
lines AS (SELECT k, line, row_number() OVER (PARTITION BY k, line) > 1 AS later FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
n AS (SELECT k, count(*) FILTER (later) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (later), 0)::BIGINT AS dup_line_chars FROM lines GROUP BY k),
a AS (SELECT doc_id, {", ".join(f"coalesce({x}, 0) AS {x}" for x in names)}, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars FROM d LEFT JOIN m USING (k) LEFT JOIN n USING (k)),
b AS (SELECT *, n_words < {repetition.FEWEST_WORDS} OR 100 * n_repeat_words > {repetition.MOST_REPEATED} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND NOT (dup_line_chars > {repetition.MOST_IN_LINES}::DOUBLE * greatest(word_chars, 1) OR {worse}) AS kept FROM b"""


_JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos, len(words) AS last FROM w),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, pos, last, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM u) WHERE pos + 4 <= last OR (pos = 1 AND last < 5)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id"""

_MIXING_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS brim FROM s),
f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level, row_number() OVER (ORDER BY brim, cap, w) AS place FROM o WINDOW before AS (ORDER BY brim, cap, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM f WHERE level <= brim) * w, cap)) AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (SELECT d.*, source_size, target, epochs, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
r AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - epochs * source_size - earlier))::BIGINT AS part_words FROM c)
SELECT doc_id, size, source_size, target, epochs * size + part_words AS taken, epochs, part_words FROM r"""


_INFILL_SQL = f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{infill.UNIT}') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(units)::BIGINT AS n, {", ".join(f"('0x' || substr(x, {8 * i - 7}, 8))::BIGINT AS h{i}" for i in (1, 2, 3, 4))} FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


_NEGATIVES_SQL = """WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM x a JOIN x b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS place FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; tests hold the others against brute force."""
    return {"op2_repetition_coverage": _repetition_sql(), "op3_jaccard_join": _JACCARD_SQL, "op8_water_filling": _MIXING_SQL, "op11_relational_infill": _INFILL_SQL, "op13_vptree_negatives": _NEGATIVES_SQL}
