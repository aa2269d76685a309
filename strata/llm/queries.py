"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.langid import held_out, learn, predict

    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    languages, model = learn(docs.where(~held_out()))
    told = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), languages, model)
    return told.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__confidence").alias("score"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.warc_zip import round_trip

    return round_trip(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.line_dedup import line_dedup

    kept = line_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256")
    )


def op4_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.wrapper import extract

    found = extract(_read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.ann import search

    rows = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.langid import held_out
    from strata.llm.toxicity import score, train

    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    labels = _read(spark, sf_dir, "labels", "doc_id", "toxic")
    # sort-merge at any size: no size decides the plan
    model, curve = train(docs.where(~held_out()).join(labels.hint("merge"), "doc_id"))
    scored = score(docs.withColumn("held_out", held_out()), model, curve)
    return scored.select("doc_id", "held_out", F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.packing import pack

    pieces = pack(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.near_dedup import near_dedup

    return near_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"), size=2)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.bpe import encode_decode

    coded = encode_decode(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op11_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.nra import search

    return search(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.rotated_codes import near_vectors

    found = near_vectors(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return found.select("vec_id", F.col("__n_links").alias("n_links"), F.col("__component").alias("component_id"), F.col("__kept").alias("kept"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.merkle import manifest

    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    one_more = (F.col("n_chars").cast("decimal(38,0)") + 1).alias("n_chars")
    tamper = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": one_more}, tamper)
    return leaves.select(
        "doc_id",
        F.col("__leaf").alias("leaf"),
        F.col("__subroot").alias("subroot"),
        F.col("__root").alias("root"),
        F.sha2(F.lower(F.hex("__proof")).cast("binary"), 256).alias("proof_sha256"),
        F.col("__folded").alias("folded_root"),
        (F.col("__folded") == F.col("__root")).alias("verified"),
    )


QUERIES = {f.__name__: f for f in (op1_langid, op2_warc, op3_line_dedup, op4_wrapper, op5_ann, op6_toxicity, op7_exact_dedup, op8_packing, op9_near_dedup, op10_bpe, op11_nra, op12_rotated_codes, op13_merkle)}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        shared AS (
            SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.top AS lost FROM keyed k LEFT JOIN shared s USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op11_nra": r"""
        WITH words AS (
            SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        tfs AS (SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY doc, term),
        lengths AS (SELECT doc, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc),
        whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, whole GROUP BY term),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        gains AS (
            SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS gain
            FROM tfs JOIN lengths USING (doc) JOIN weights USING (term), whole),
        scored AS (SELECT item_id, doc, any_value(doc_id) AS doc_id, CAST(sum(gain) AS BIGINT) AS score FROM asked JOIN gains USING (term) GROUP BY item_id, doc),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op12_rotated_codes": r"""
        WITH RECURSIVE vectors AS (
            SELECT row_number() OVER () AS v, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        usable AS (
            SELECT v, vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM vectors
            WHERE label IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e) AND list_bool_and(list_transform(e, lambda x: isfinite(x)))
              AND list_bool_or(list_transform(e, lambda x: x <> 0))),
        links AS (
            SELECT a.v AS a, b.v AS b FROM usable a JOIN usable b ON a.label = b.label AND a.v <> b.v AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
        reached AS (SELECT v, v AS other FROM vectors UNION SELECT r.v, l.b FROM reached r JOIN links l ON l.a = r.other),
        least AS (SELECT r.v, min(o.vec_id) AS component_id FROM reached r JOIN vectors o ON o.v = r.other GROUP BY r.v),
        counts AS (SELECT a AS v, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
        FROM vectors JOIN least USING (v) LEFT JOIN counts USING (v)""",
    "op13_merkle": r"""
        WITH RECURSIVE told AS (
            SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                       lambda i: list_transform(range(8), lambda k: (ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) >> k) & 1)))),
                       lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc,
                   CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
                   || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
                   || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
                   CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
                   CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS size,
                   CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END AS more
            FROM documents),
        hashed AS (
            SELECT doc_id, coalesce('+' || lang, '') AS g, sha256(head || size || tail) AS leaf,
                   CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || more || tail) ELSE sha256(head || size || tail) END AS shown FROM told),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
        nodes AS (
            SELECT g, 0 AS lvl, pos, leaf AS h, n FROM leaves
            UNION ALL
            SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, lvl, pos // 2),
        subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, lvl FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS lvl, pos, subroot AS h, n FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, pos // 2),
        steps AS (
            SELECT g, lvl, pos, h FROM nodes WHERE n > 1
            UNION ALL SELECT s.g, s.lvl + t.lvl, t.pos, t.h FROM subroots s JOIN tops t ON t.n > 1),
        root AS (SELECT h AS root FROM tops WHERE n = 1),
        paths AS (
            SELECT l.g, l.pos AS place, 0 AS lvl, l.pos, l.shown AS h, '' AS proof, s.lvl AS turn, s.pos AS rank,
                   s.lvl + (SELECT max(lvl) FROM tops) AS top
            FROM leaves l JOIN subroots s USING (g)
            UNION ALL
            SELECT p.g, p.place, p.lvl + 1, CASE WHEN p.lvl = p.turn THEN p.rank ELSE p.pos END // 2,
                   sha256(CASE WHEN o.pos < CASE WHEN p.lvl = p.turn THEN p.rank ELSE p.pos END THEN o.h || p.h ELSE p.h || coalesce(o.h, '') END),
                   p.proof || coalesce(o.h, ''), p.turn, p.rank, p.top
            FROM paths p LEFT JOIN steps o ON o.g = p.g AND o.lvl = p.lvl AND o.pos = xor(CASE WHEN p.lvl = p.turn THEN p.rank ELSE p.pos END, 1)
            WHERE p.lvl < p.top)
        SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(p.proof) AS proof_sha256, p.h AS folded_root, p.h = r.root AS verified
        FROM leaves l JOIN subroots s USING (g) JOIN paths p ON p.g = l.g AND p.place = l.pos AND p.lvl = p.top, root r""",
}
