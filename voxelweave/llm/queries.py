"""Registered queries of the thirteen operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, embedding_dedup, exact_dedup, hard_negatives, licenses, mixing, near_dedup, quality, repeats, structure, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "src", "n_tok", F.round("weight", 9).alias("weight"), "epoch", "place")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode_decode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_table(spark, sf_dir, "conversations"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    weights = toxicity.train(docs, labels.where(~held_out).select("doc_id", "toxic"))
    out = toxicity.score(docs, weights)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _table(spark, sf_dir, "conversations")
    summary, turns = structure.repair(structure.damaged(chats))
    every = chats.select(F.col("conv_id").alias("conv")).distinct()
    rows = every.join(summary, F.col("conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    shas = structure.digests(turns)
    rows = rows.join(shas, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return rows.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), sha)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), noisy)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_near_dedup, op2_mix_sources, op3_embedding_dedup, op4_byte_bpe, op5_quality, op6_licenses, op7_chat, op8_repeats, op9_exact_dedup, op10_toxicity]
    own += [op11_structure, op12_hard_negatives, op13_nearest]
    return {f.__name__: f for f in own}


def _bisected(number: int) -> str:
    """One refinement of both exponents in SQL: cells of the grid below those of the step before."""
    width = f"power(128.0::DOUBLE, -{number})"
    return f"""
            t{number} AS (SELECT g.goal, g.lo + i.range * {width} alpha, i.range i, share, n FROM p
                 CROSS JOIN (SELECT 'e' goal, e lo FROM c{number - 1} UNION ALL SELECT 'r', r FROM c{number - 1}) g CROSS JOIN range(129) i),
            u{number} AS (SELECT goal, alpha, i, sum(power(share, alpha)) z, sum(power(share, alpha) * ln(share)) pl,
                 max(power(share, alpha) / share) worst, max(n) n FROM t{number} GROUP BY ALL),
            c{number} AS (SELECT max(alpha) FILTER (goal = 'e' AND (ln(z) - alpha * pl / z >= 0.95::DOUBLE * ln(n) - 1e-12 OR i = 0)) e,
                 coalesce(max(alpha) FILTER (goal = 'r' AND worst / z > 4 + 1e-12 AND i < 128), min(alpha) FILTER (goal = 'r')) r,
                 max(CASE WHEN goal = 'r' AND i = 0 AND worst / z <= 4 + 1e-12 THEN 1 END) free FROM u{number}),"""


def _repair_sql() -> str:
    """The edit costs as a recursion over a conversation's rows: for each state the cheapest edits so far, as a text of
    the cost in eight digits and the letters, so that the least text is the cheapest, first in ASCII order."""
    plus = lambda x, cost, letters: f"(lpad((substr({x}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({x}, 9) || '{letters}')"
    never = "'9'"
    # before a row (or at the end) turns may be inserted
    ins = {
        "n": "n", "s": "s", "u": f"least(u, {plus('n', 3, 'I')}, {plus('s', 3, 'I')}, {plus('a', 3, 'I')})",
        "a": f"least(a, {plus('u', 3, 'I')}, {plus('n', 6, 'II')}, {plus('s', 6, 'II')})",
    }
    edit = {k: [plus(k, 4, "D")] for k in "nsua"}
    more = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    for state, after in (("n", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
        edit[after].append(f"CASE WHEN fault IN ('ok', 'truncated') THEN {plus(state, f'3 + {more}', 'R')} ELSE {never} END")
    for initial, state, after in (("s", "n", "s"), ("u", "n", "u"), ("u", "s", "u"), ("u", "a", "u"), ("a", "u", "a")):
        edit[after].append(f"CASE WHEN fault IN ('ok', 'truncated') AND initial = '{initial}' THEN {plus(state, more, 'K')} ELSE {never} END")
    never0 = "'09999999'"
    bits = "flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda b: [ord(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"
    return f"""
            WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {crc} % 20 kind FROM conversations),
            d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text,
                unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) c FROM k WHERE kind <> 0),
            o AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) k,
                regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) last FROM d),
            f AS (SELECT *, substr(role, 1, 1) initial, CASE WHEN last = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                WHEN last IN ('.', '!', '?') THEN 'ok' ELSE 'truncated' END fault FROM o),
            g AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) prev FROM f),
            counts AS (SELECT conv, any_value(conv_id) conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps,
                count(*) FILTER (fault = 'blank') blank, count(*) FILTER (fault = 'duplicate') duplicate, count(*) FILTER (fault = 'truncated') truncated,
                count(*) FILTER (prev IS NOT NULL AND prev || initial NOT IN ('su', 'ua', 'au')) illegal, count(*) n_rows FROM g GROUP BY conv),
            dp AS (SELECT conv, 0::BIGINT k, '00000000' n, {never0} s, {never0} u, {never0} a FROM counts
                UNION ALL
                SELECT conv, k, {", ".join(f"least({', '.join(edit[x])}) {x}" for x in "nsua")}
                FROM (SELECT i.conv, f.k, initial, fault, {", ".join(f"{ins[x]} {x}" for x in "nsua")} FROM (SELECT conv, k, n, s, u, a FROM dp) i JOIN f ON i.conv = f.conv AND f.k = i.k + 1)),
            won AS (SELECT conv, least(n, {ins["a"]}) best FROM (SELECT conv, n, s, u, a FROM dp JOIN counts USING (conv) WHERE k = n_rows)),
            e AS (SELECT conv, substr(best, 1, 8)::BIGINT AS cost, substr(best, 9) audit FROM won),
            l AS (SELECT conv, j, substr(audit, j, 1) letter FROM (SELECT conv, audit, unnest(range(1, len(audit) + 1)) j FROM e)),
            m AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv ORDER BY j) k FROM l),
            t AS (SELECT m.conv, j, letter, f.role, f.text, f.initial,
                row_number() OVER (PARTITION BY m.conv ORDER BY j) i,
                first_value(letter = 'K' AND f.initial = 's') OVER (PARTITION BY m.conv ORDER BY j) sys FROM m LEFT JOIN f ON m.conv = f.conv AND m.k = f.k WHERE letter <> 'D'),
            r AS (SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (i - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
                || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) whole FROM t GROUP BY conv)
            SELECT x.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate,
                coalesce(truncated, 0)::BIGINT truncated, coalesce(illegal, 0)::BIGINT illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(audit, '') audit, sha256(coalesce(whole, '')) repaired_sha256
            FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') conv FROM conversations) x
            LEFT JOIN counts USING (conv) LEFT JOIN e USING (conv) LEFT JOIN r USING (conv)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_structure": _repair_sql(),
        "op12_hard_negatives": """
            WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) q
                 FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id anchor_id, b.vec_id id, a.label = b.label same, list_inner_product(a.q, b.q)::BIGINT score
                 FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
            p AS (SELECT anchor_id, id positive_id, score positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
            n AS (SELECT p.*, s.id negative_id, score negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id) AS rank
                 FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
            SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
        "op2_mix_sources": f"""
            WITH d AS (SELECT doc_id, coalesce(source, '') src, coalesce(doc_id::VARCHAR, 'null') k,
                 len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT n_tok FROM documents),
            s AS (SELECT src, sum(n_tok)::BIGINT tokens, count(*) docs, ceil(count(*) / 512.0)::BIGINT blocks FROM d GROUP BY 1),
            p AS (SELECT src, tokens, tokens::DOUBLE / (SELECT sum(tokens) FROM s) share, (SELECT count(*) FROM s WHERE tokens > 0) n FROM s WHERE tokens > 0),
            c0 AS (SELECT 0.0::DOUBLE e, 0.0::DOUBLE r),{_bisected(1)}{_bisected(2)}{_bisected(3)}
            a AS (SELECT greatest(c3.e, CASE WHEN c1.free = 1 THEN 0 ELSE least(c3.r + power(128.0::DOUBLE, -3), 1) END) alpha FROM c3, c1),
            w AS (SELECT src, power(share, alpha) / sum(power(share, alpha)) OVER () weight FROM p, a),
            q AS (SELECT src, blocks, tokens, coalesce(weight, 0) weight, weight * (SELECT sum(tokens) FROM s) / tokens passes FROM s LEFT JOIN w USING (src)),
            plan AS (SELECT src, blocks, weight, coalesce(floor(passes + 1e-9), 1)::INT AS whole, coalesce((passes - floor(passes + 1e-9)) * tokens, 0) rest FROM q),
            f AS (SELECT d.*, plan.* EXCLUDE (src), ('0x' || substr(md5(k || '|17'), 1, 8))::BIGINT % blocks block FROM d JOIN plan USING (src)),
            b AS (SELECT src, block, any_value(whole) AS whole, sum(n_tok) in_block FROM f GROUP BY 1, 2),
            cut AS (SELECT src, block, in_block, coalesce(sum(in_block) OVER (PARTITION BY src ORDER BY md5(block || '|' || (whole + 1) || '|17'), block
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM b),
            x AS (SELECT f.*, in_block, bef, coalesce(sum(n_tok) OVER (PARTITION BY src, block ORDER BY md5(k || '|' || (whole + 1) || '|17'), k
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS into_block FROM f JOIN cut USING (src, block)),
            y AS (SELECT *, whole + CASE WHEN bef + in_block <= rest OR (bef < rest AND bef + into_block < rest) THEN 1 ELSE 0 END copies FROM x)
            SELECT doc_id, src, n_tok, round(weight, 9) weight, epoch::INT epoch,
                 md5(src || '|' || block || '|' || epoch || '|17') || md5(k || '|' || epoch || '|17') place
            FROM (SELECT *, unnest(range(1, copies + 1)) epoch FROM y)""",
        "op7_chat": """
            WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text
                       FROM conversations WHERE conv_id IS NOT NULL),
            n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) k FROM t),
            p AS (SELECT conv_id, k, role, text,
                         string_agg(md5(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY k
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) pre,
                         max(k) OVER (PARTITION BY conv_id) n FROM n),
            w AS (SELECT pre, min(conv_id) conv_id, max(n) n FROM p WHERE k = n GROUP BY pre),
            m AS (SELECT conv_id, n FROM w WHERE pre NOT IN (SELECT pre FROM p WHERE k < n))
            SELECT m.conv_id, CAST(m.n AS INT) n_turns, CAST(floor((k - 1) / 1000) AS INT) part,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) rendered
            FROM n JOIN m USING (conv_id) GROUP BY ALL""",
        "op9_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w keep_id, count(*) OVER w group_size,
                   doc_id = max(doc_id) OVER w kept, sha256(coalesce(text, '')) text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
