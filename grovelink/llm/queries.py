"""Named queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    ann,
    bpe,
    chat,
    codes,
    decontaminate,
    exact_dedup,
    importance,
    licenses,
    near_dedup,
    packing,
    pii,
    quality,
    repeats,
)
from .common import table

CAPACITY = 2048


def op1_best_fit_packing(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.cut_pieces(table(spark, sf, "documents"), path, CAPACITY)
    light = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(light, "length", ["doc_id", "piece", "ids_crc32"], CAPACITY)


def op3_exact_dedup(spark, sf):
    rows = exact_dedup.deduplicate(table(spark, sf, "documents"))
    return rows.select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


# a demonstration key; a deployment takes its own from its secret store
PII_KEY = b"grovelink pseudonyms"


def op2_pii_feistel(spark, sf):
    done = pii.pseudonymise(table(spark, sf, "documents"), PII_KEY)

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    return done.select(
        F.col("document.doc_id").alias("doc_id"),
        "text",
        F.size("found").cast("long").alias("n_values"),
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
    )


def op4_quality_trees(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf, "labels")))
    return scored.select(
        F.col("document.doc_id").alias("doc_id"),
        quality.held_out(F.col("document.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_bpe_automaton(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(table(spark, sf, "documents"), path, digests=True)


def op6_repeated_bytes(spark, sf):
    cut = repeats.remove_repeats(table(spark, sf, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_license_paragraphs(spark, sf):
    docs = table(spark, sf, "documents")
    found = licenses.scan(docs, licenses.train(docs))
    families = F.array_sort(F.array_distinct("found.family"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(families, ",").alias("families"),
        F.array_join(F.col("found.line").cast("array<string>"), ",").alias("lines"),
    )


def op8_multi_index(spark, sf):
    return ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_minhash_join(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op9_chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digests(chat.format_conversations(turns.unionByName(tricky)))


def op11_importance_resampling(spark, sf):
    drawn = importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_winnowing(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return decontaminate.contaminated(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_grid_codes(spark, sf):
    found, codebooks = codes.compress(table(spark, sf, "embeddings"))
    hexed = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")))
    return codes.with_label_errors(found).select(
        "vec_id",
        F.array_join(hexed, "").alias("code"),
        "error",
        "label_error",
        F.lit(codebooks.digest()).alias("codebooks_sha256"),
    )


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_pii_feistel": op2_pii_feistel,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_trees": op4_quality_trees,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_repeated_bytes": op6_repeated_bytes,
    "op7_license_paragraphs": op7_license_paragraphs,
    "op8_multi_index": op8_multi_index,
    "op9_chat_format": op9_chat_format,
    "op10_minhash_join": op10_minhash_join,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_winnowing": op12_winnowing,
    "op13_grid_codes": op13_grid_codes,
}

def _words_sql(column: str) -> str:
    lowered = f"translate(coalesce({column}, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


IMPORTANCE_SQL = f"""
    WITH docs AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS words FROM documents),
    target AS (SELECT unnest({_words_sql("text")}) AS w FROM benchmark),
    in_docs AS MATERIALIZED (SELECT r, unnest(words) AS w FROM docs),
    vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM in_docs UNION SELECT w FROM target)),
    steps AS (
        SELECT list(list_reduce(
            range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
            ORDER BY i) AS steps
        FROM range(256) t(i)),
    hashed AS MATERIALIZED (
        SELECT w, xor(list_reduce(
            list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
            lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)
            % {importance.BUCKETS} AS bucket
        FROM vocabulary, steps),
    s AS (SELECT bucket, count(*) AS n FROM in_docs JOIN hashed USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (w) GROUP BY bucket),
    sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS big_s, coalesce((SELECT sum(n) FROM t), 0) AS big_t),
    gains AS (
        SELECT b AS bucket, CAST(floor(1000.0::DOUBLE * ln(
            CAST((coalesce(t.n, 0) + 1) * (big_s + {importance.BUCKETS}) AS DOUBLE)
            / CAST((coalesce(s.n, 0) + 1) * (big_t + {importance.BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
        FROM range({importance.BUCKETS}) x(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b, sums),
    weights AS (
        SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
        FROM in_docs JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
    scored AS (
        SELECT doc_id, CAST(length(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(
                   sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
                   + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
        FROM docs LEFT JOIN weights USING (r)),
    ranked AS (
        SELECT *, row_number() OVER (ORDER BY n_features >= {importance.LEAST_WORDS} DESC, score DESC,
                                     doc_id NULLS LAST, weight DESC, n_features DESC) AS place,
               count(*) FILTER (n_features >= {importance.LEAST_WORDS}) OVER () AS eligible
        FROM scored)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN place <= {importance.PERCENT} * eligible // 100 THEN place END AS rank
    FROM ranked"""

WINNOWING_SQL = f"""
    WITH docs AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS words FROM documents),
    items AS (SELECT item_id, {_words_sql("text")} AS words FROM benchmark),
    spans AS (SELECT item_id, words, least(length(words), {decontaminate.SPAN}) AS n FROM items WHERE length(words) > 0),
    cut AS (SELECT item_id, words, n, unnest(range(1, length(words) - n + 2)) AS i FROM spans),
    held AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM cut),
    places AS (
        SELECT r, words, n, unnest(range(1, length(words) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM held)),
    met AS MATERIALIZED (
        SELECT r, n, i, item_id
        FROM (SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS w FROM places) JOIN held USING (n, w)),
    hit AS (
        SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
    listed AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(length(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)"""


def _codes_sql() -> str:
    """All rounds of the codebooks, written out."""
    def assigned(n: int) -> str:
        return f"""
    near{n} AS MATERIALIZED (
        SELECT r, p, min({{'d': d, 'e': e}}) AS best
        FROM (SELECT r, p, e, sum((x - c) * (x - c)) AS d FROM cells JOIN book{n} USING (p, k) GROUP BY r, p, e)
        GROUP BY r, p)"""

    rounds = "".join(
        f"""{assigned(n)},
    book{n + 1} AS MATERIALIZED (
        SELECT p, e, k, coalesce(CAST(floor(total::DOUBLE / n) AS BIGINT), c) AS c
        FROM book{n} LEFT JOIN (
            SELECT p, best.e AS e, k, sum(x) AS total, count(*) AS n
            FROM cells JOIN near{n} USING (r, p) GROUP BY p, best.e, k) USING (p, e, k)),"""
        for n in range(codes.ROUNDS)
    )
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
        WHERE len(embedding) > 0
          AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    long AS (
        SELECT r, unnest(range(len(embedding))) AS i,
               unnest(list_transform(embedding, lambda v: CAST(floor(v::DOUBLE * {codes.SCALE}) AS BIGINT))) AS x,
               len(embedding) // {codes.PARTS} AS wide
        FROM kept),
    cells AS MATERIALIZED (SELECT r, i // wide AS p, i % wide AS k, x FROM long),
    book0 AS MATERIALIZED (SELECT p, r - 1 AS e, k, x AS c FROM cells WHERE r <= {codes.ENTRIES}),{rounds}{assigned(codes.ROUNDS)},
    done AS (
        SELECT r, string_agg(printf('%02x', CAST(best.e AS INT)), '' ORDER BY p) AS code,
               CAST(sum(best.d) AS BIGINT) AS error
        FROM near{codes.ROUNDS} GROUP BY r),
    book AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, k)) AS digest FROM book{codes.ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           digest AS codebooks_sha256
    FROM kept JOIN done USING (r), book"""


ORACLE_SQL = {
    "op11_importance_resampling": IMPORTANCE_SQL,
    "op12_winnowing": WINNOWING_SQL,
    "op13_grid_codes": _codes_sql(),
    "op3_exact_dedup": f"""
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}',
                                     '{exact_dedup.LOWER}') AS norm
            FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM t""",
    "op9_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}'
            UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn))
                   AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT)
                   AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               CAST(sum(length(regexp_replace(role, '([<\\[])(!*)(\\||/?s>|/?INST\\])',
                                              '\\1!\\2\\3', 'g'))
                      + length(regexp_replace(text, '([<\\[])(!*)(\\||/?s>|/?INST\\])',
                                              '\\1!\\2\\3', 'g'))
                      + {len(chat.TURN + chat.TEXT + chat.END)}) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id""",
}
