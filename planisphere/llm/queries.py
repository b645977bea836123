"""Queries of the operators, ``op<N>_<name>``, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from planisphere.llm.common import WORD, table

QUERIES = {}
SQL = {}

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


#: DuckDB: leaves, levels of nodes, and the audited documents folded level by level. The checksum runs bit by bit.
MERKLE_SQL = f"""
WITH RECURSIVE marked AS (
  SELECT doc_id, source, sha256({' || '.join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    sha256({' || '.join(map(_field, ("doc_id", "source", "lang", "n_chars")))} || {_field(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")}) AS lowered,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, leaf, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS found,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, row_number() OVER () AS row FROM marked
), lower_nodes AS (
  SELECT 0 AS level, source, rank, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT level + 1, source, rank // 16, sha256(string_agg(h, '' ORDER BY rank)), (max(n) + 15) // 16 FROM lower_nodes WHERE n > 1 GROUP BY level, source, rank // 16
), subroots AS (
  SELECT source, h, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM lower_nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, rank, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, rank // 16, sha256(string_agg(h, '' ORDER BY rank)), (max(n) + 15) // 16 FROM upper_nodes WHERE n > 1 GROUP BY level, rank // 16
), top AS (SELECT h AS root, level AS height FROM upper_nodes WHERE n = 1
), steps AS (
  SELECT row, level, rank // (16 ** level)::BIGINT AS at, l.source, true AS inside FROM leaves l, generate_series(0, 15) g(level)
    WHERE level < (SELECT height FROM subroots s WHERE s.source IS NOT DISTINCT FROM l.source)
  UNION ALL
  SELECT row, height + level, s.rank // (16 ** level)::BIGINT, NULL, false FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, generate_series(0, 15) g(level)
    WHERE level < (SELECT height FROM top)
), runs AS (
  SELECT row, t.level, string_agg(h, '' ORDER BY n.rank) FILTER (n.rank < t.at) AS before, string_agg(h, '' ORDER BY n.rank) FILTER (n.rank > t.at) AS behind
  FROM (SELECT * FROM steps WHERE inside) t JOIN lower_nodes n ON t.source IS NOT DISTINCT FROM n.source AND t.level = n.level AND t.at // 16 = n.rank // 16 GROUP BY ALL
  UNION ALL
  SELECT row, t.level, string_agg(n.h, '' ORDER BY n.rank) FILTER (n.rank < t.at), string_agg(n.h, '' ORDER BY n.rank) FILTER (n.rank > t.at)
  FROM (SELECT s.*, b.height FROM steps s JOIN leaves l USING (row) JOIN subroots b ON l.source IS NOT DISTINCT FROM b.source WHERE NOT inside) t
  JOIN upper_nodes n ON t.level - t.height = n.level AND t.at // 16 = n.rank // 16 GROUP BY ALL
), proofs AS (
  SELECT row, string_agg(coalesce(before, '') || coalesce(behind, ''), '' ORDER BY level) AS proof FROM runs GROUP BY row
), folds AS (
  SELECT row, 0 AS level, found AS h FROM leaves
  UNION ALL
  SELECT f.row, f.level + 1, sha256(coalesce(before, '') || f.h || coalesce(behind, '')) FROM folds f JOIN runs r ON f.row = r.row AND f.level = r.level
)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN top
LEFT JOIN proofs p ON l.row = p.row JOIN (SELECT row, max_by(h, level) AS h FROM folds GROUP BY row) f ON l.row = f.row
"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op9_bpe_codec")
def op9(spark, sf_dir):
    from planisphere.llm.bpe import bpe_encode

    coded = bpe_encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), packed=True, decode=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op6_token_counts")
def op6(spark, sf_dir):
    from planisphere.llm.wordpiece import sentence_pieces, token_counts

    return token_counts(table(spark, sf_dir, "documents"), sentence_pieces(tokenizer("piece_bpe_32k.model")))


def _mixing_sql():
    from planisphere.llm.mixing import SQL as text

    return text


@query("op10_source_mixing", _mixing_sql())
def op10(spark, sf_dir):
    from planisphere.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_simhash_neardup")
def op4(spark, sf_dir):
    from planisphere.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)


@query("op8_embedding_neardup")
def op8(spark, sf_dir):
    from planisphere.llm.rangejoin import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query("op2_learned_partitions")
def op2(spark, sf_dir):
    from planisphere.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op7_toxicity")
def op7(spark, sf_dir):
    from planisphere.llm.toxicity import fit, toxicity

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity(docs, fit(docs, labels.filter(~held_out)), threshold=0.7)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op1_quality_bayes")
def op1(spark, sf_dir):
    from planisphere.llm.quality import fit, judge

    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))
    return judged.select("doc_id", "host", "path", "evidence", "path_rate", "posterior", "kept")


@query("op3_html_layout")
def op3(spark, sf_dir):
    from planisphere.llm.html import visible_text

    return visible_text(table(spark, sf_dir, "pages"))


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    from planisphere.llm.suffix import deduplicate

    done = deduplicate(table(spark, sf_dir, "documents"), span=50)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query("op11_best_fit_packing")
def op11(spark, sf_dir):
    from planisphere.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)


def planted_repeats(text, doc_id):
    """The text of every document whose crc32 ends in 0 with a stretch of its words repeated to the end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    period = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    from planisphere.llm.periodic import periodic_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", planted_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs, least=6, repeats=4)
    # the longest run; of equal ones the first, then the shortest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark, sf_dir):
    from planisphere.llm.merkle import manifest

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", CAPITALS, CAPITALS.lower())).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), found={"text": text})
