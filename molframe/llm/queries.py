"""One query per operator, each over its whole table, and the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact, infill, langid, merkle, minhash, mixing, secrets, sharding, suffix_array, suffix_tree, toxicity
from .common import cut, table


def op1_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op3_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("found")).alias("spans"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


def op9_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = cut(chat.format_chats(rows))
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(line).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.rearranged(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = infill.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.filter(~toxicity.held_out()), labels)
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_vector_sharding, op2_suffix_array_dedup, op3_suffix_tree_dedup, op4_secret_scan, op5_minhash_dedup, op6_decontaminate, op7_mixing, op8_exact_dedup, op9_crf_language, op10_chat_format, op11_merkle_manifest, op12_fill_in_middle, op13_toxicity)} | {"pipeline": corpus_pipeline.run}

SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op10_chat_format": r"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        p AS (SELECT *, role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS merged, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
            replace(replace(text, '\', '\\'), '<|', '<\|') AS safe, replace(replace(role, '\', '\\'), '<|', '<\|') AS who FROM r)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(safe) + CASE WHEN merged THEN length('<|part|>') ELSE length('<|turn|><|text|><|end|>') + 1 + length(who) END)::BIGINT AS formatted_chars
        FROM p GROUP BY conv_id""",
    # the CRC-32 is worked out bit by bit; `up` holds all levels of the trees, `fold` climbs them again from the changed leaves
    "op11_merkle_manifest": r"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, coalesce('=' || source, '') AS tree, source, lang, n_chars, text,
                list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)),
                    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
        changed AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM doc),
        leaf AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS h2
            FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM changed)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
        up(tree, level, pos, h, n) AS (
            SELECT tree, 0, pos, h, n FROM placed
            UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, level, pos // 3, n),
        subs AS (SELECT tree, h, level FROM up WHERE n = 1),
        over_(level, pos, h, n) AS (
            SELECT 0, row_number() OVER (ORDER BY encode(tree)) - 1, h, count(*) OVER () FROM subs
            UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM over_ WHERE n > 1 GROUP BY level, pos // 3, n),
        sub AS (SELECT *, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM subs),
        low AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
            FROM up a JOIN up b ON b.tree = a.tree AND b.level = a.level AND b.pos // 3 = a.pos // 3 WHERE a.n > 1 GROUP BY ALL),
        high AS (SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
            FROM over_ a JOIN over_ b ON b.level = a.level AND b.pos // 3 = a.pos // 3 WHERE a.n > 1 GROUP BY ALL),
        path AS (
            SELECT p.tree, p.pos, low.level, low.l, low.r FROM placed p JOIN low ON low.tree = p.tree AND low.pos = p.pos // (3 ** low.level)::BIGINT
            UNION ALL SELECT p.tree, p.pos, s.level + high.level, high.l, high.r FROM placed p JOIN sub s ON s.tree = p.tree JOIN high ON high.pos = s.pos // (3 ** high.level)::BIGINT),
        proof AS (SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256 FROM path GROUP BY ALL),
        fold(tree, pos, level, h) AS (
            SELECT tree, pos, 0, h2 FROM placed
            UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(p.l || f.h || p.r) FROM fold f JOIN path p ON p.tree = f.tree AND p.pos = f.pos AND p.level = f.level),
        folded AS (SELECT tree, pos, arg_max(h, level) AS folded_root FROM fold GROUP BY ALL)
        SELECT doc_id, placed.h AS leaf, sub.h AS subroot, root.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root.h AS verified
        FROM placed JOIN folded USING (tree, pos) JOIN sub USING (tree) LEFT JOIN proof ON proof.tree = placed.tree AND proof.pos = placed.pos, (SELECT h FROM over_ WHERE n = 1) root""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS unit FROM documents),
        e AS (SELECT *, len(unit) AS n, ('0x' || h[1:8])::BIGINT % (len(unit) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(unit) + 1) AS c2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
        p AS (SELECT *, array_to_string(unit[1:least(c1, c2)], '') AS pre, array_to_string(unit[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid, array_to_string(unit[greatest(c1, c2) + 1:], '') AS suf,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p""",
}
