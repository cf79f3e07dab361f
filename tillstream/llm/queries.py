"""The registered queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillstream.llm import (bit_search, block_names, chat_trees, collocations, licence_rules, line_crf, mixing, partenum, pii,
                            sampled_pieces, secret_scan, toxicity, wavelet)
from tillstream.llm.common import read, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Pieces of SQL that several oracles use; DuckDB's lower() would change more than A-Z.
SQL_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and one more conversation whose texts are control strings."""
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    return table.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], table.schema))


# The length of a formatted conversation: its turns with their marks, and a backslash per control string.
_ESCAPED = "length(regexp_replace({}, '" + chat_trees.ESCAPE + "', '\\1\\\\\\2\\3', 'g'))"


@query("op1_chat_trees", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS trained,
             sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + {len(chat_trees.START) + len(chat_trees.SEP) + len(chat_trees.END)}) AS chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars FROM g""")
def op1_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = chat_trees.format_paths(chat_trees.chain_replies(_conversations(spark, sf_dir)))
    return chat_trees.read_back(formatted.select(F.col("root.conv_id").alias("conv_id"), "formatted", "loss"), ["conv_id"])


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, secret_scan.KINDS[:3]), "base_sha256", listed.alias("spans"), count("random"))


@query("op3_source_mix", f"""
WITH d AS (
  SELECT doc_id, source, len({SQL_WORDS.format("coalesce(text, '')")}) AS size,
         greatest(0.05, length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]+', '', 'g'))
                  / greatest(length(coalesce(text, '')), 1)) AS weight,
         (CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496e0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3e0, 1e0, 2e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2e0 * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS ratio,
             (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * w, cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs,
             CAST(round(p.target) AS BIGINT) - p.epochs * p.source_size
             - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS space
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, space)) AS BIGINT) AS taken FROM k""")
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_jaccard_join", f"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS.format(SQL_LOWER)} AS words FROM documents),
d AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM w),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM d),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
           FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common WHERE 100 * shared >= 85 * (na + nb - shared)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, CAST(len(d.grams) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM d LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id""")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(read(spark, sf_dir, "documents"), n=4, percent=85)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_licence_rules", licence_rules.oracle())
def op6_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_rules.scan(read(spark, sf_dir, "documents"))


@query("op7_sampled_pieces")
def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each sampled segmentation, and whether it decodes to the text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").withColumn("text_hash", F.xxhash64(text_or_empty()))
    samples = sampled_pieces.sample_encodings(docs, path, carry=("doc_id", "text_hash"))
    return samples.select("doc_id", "sample", F.size("ids").cast("long").alias("n_tokens"),
                          F.xxhash64("ids").alias("ids_hash"), "log_prob", "inclusion",
                          (F.xxhash64(sampled_pieces.decoded(path, F.col("ids"))) == F.col("text_hash")).alias("decodes"))


@query("op8_line_crf")
def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_block_names", """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def op9_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_wavelet_shards")
def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op11_bit_search", f"""
WITH d AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '{bit_search.TERM}') AS terms FROM documents),
c AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d WHERE len(terms) > 0),
t AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, docs),
q AS (SELECT item_id, unnest(regexp_extract_all({SQL_LOWER}, '{bit_search.TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""")
def op11_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op12_pii_spans")
def op12_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(read(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k.name) for k in pii.BASE], F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
                        listed("spans").alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))


@query("op13_toivonen_phrases", f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({SQL_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
o AS (SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(words) >= size),
f AS (SELECT lang, size, phrase, count(*) AS many, string_split(phrase, ' ') AS words FROM o GROUP BY lang, size, phrase),
n AS (SELECT lang, CAST(sum(many) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size > 1 AND many >= 30),
i AS (SELECT c.lang, c.many, array_to_string(c.words[s.s:s.s + m.m - 1], ' ') AS phrase FROM c, (VALUES (2), (3)) AS m(m), (VALUES (1), (2), (3)) AS s(s)
      WHERE m.m < c.size AND s.s + m.m - 1 <= c.size),
x AS (SELECT lang, phrase, max(many) AS around FROM i GROUP BY lang, phrase),
k AS (SELECT c.lang, c.phrase, c.many AS a, k.k, array_to_string(c.words[1:k.k], ' ') AS head, array_to_string(c.words[k.k + 1:], ' ') AS tail
      FROM c LEFT JOIN x ON x.lang = c.lang AND x.phrase = c.phrase, (VALUES (1), (2), (3)) AS k(k)
      WHERE k.k < c.size AND (x.around IS NULL OR 100 * x.around < 80 * c.many)),
t AS (SELECT k.lang, k.phrase, k.a, k.k, h.many AS l, r.many AS r, CAST((2000000 * CAST(k.a AS HUGEINT)) // (h.many + r.many) AS BIGINT) AS score
      FROM k JOIN f h ON h.lang = k.lang AND h.phrase = k.head JOIN f r ON r.lang = k.lang AND r.phrase = k.tail),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000""")
def op13_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))
