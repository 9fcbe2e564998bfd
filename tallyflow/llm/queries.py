"""Named queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op4_bpe")
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm.bpe import encode_documents

    encoded = encode_documents(table(spark, folder, "documents"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm.packing import pack_documents

    packed = pack_documents(table(spark, folder, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


@query("op9_id_store")
def op9_id_store(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm import idstore
    from tallyflow.runtime import Scratch

    docs, at = table(spark, folder, "documents"), Scratch(spark, "idstore").path
    manifest = idstore.write_shards(docs, at)
    index, buckets = idstore.build_index(manifest, at)
    places = idstore.locate(manifest, index, buckets).join(idstore.shard_starts(manifest), "file")
    return idstore.fetch(places, at).select(
        F.col("key").alias("doc_id"),
        (F.col("before") + F.col("first")).alias("start"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query(
    "op1_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html)::BIGINT AS n, sha256(html) AS digest,
                 CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
           CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact FROM d""",
)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm import warc
    from tallyflow.runtime import Scratch

    at = Scratch(spark, "warc").path
    warc.write_archives(table(spark, folder, "pages"), at)
    records = warc.read_records(warc.build_index(spark, at), at)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm.toxicity import score_documents

    scored = score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("evidence").alias("n_evidence"))


@query(
    "op10_near_duplicates",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                              ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]))) END AS s FROM w),
    e AS (SELECT doc_id, unnest(s) AS h FROM g),
    n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM g),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)),
    sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS id, doc_id AS reached FROM n UNION SELECT r.id, sym.b FROM r JOIN sym ON sym.a = r.reached)
    SELECT doc_id, n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM n JOIN r ON r.id = n.doc_id GROUP BY doc_id, n_shingles""",
)
def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm.neardup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), width=3, threshold=85)


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm.quality import judge

    judged = judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm import merkle

    rows = merkle.with_edit(merkle.with_next(table(spark, folder, "documents")))
    for text, name in (("text", "own"), ("edited", "after"), ("next_text", "next")):
        rows = merkle.with_tree(rows, text, name)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        merkle.fingerprint("own").alias("fingerprint"),
        merkle.fingerprint("after").alias("edited_fingerprint"),
        merkle.likeness("own", "after").alias("near_edited"),
        merkle.likeness("own", "next").alias("near_next"),
    )


@query("op5_licenses")
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm.licenses import label_list, scan_documents

    places = F.transform("exact", lambda x: x["first_word"])
    return scan_documents(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        F.size("exact").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        label_list("exact").alias("base_labels"),
        label_list("exact", "fuzzy").alias("labels"),
        "score",
    )


def _masked(spans: str):
    return F.aggregate(spans, F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long")


_RENDERED = "list_aggregate(list_transform({0}, lambda m: concat('<|', m.role, '|>', chr(10), m.text, '<|end|>', chr(10))), 'string_agg', '')"
_LEARNED = "coalesce(list_sum(list_transform(list_filter({0}, lambda m: m.role = 'assistant'), lambda m: length(m.text) + 7)), 0)::BIGINT"


@query(
    "op6_preferences",
    f"""
    WITH c AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                                    ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS m
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    l AS (SELECT conv_id, m, nullif(len(list_filter(range(1, len(m) + 1), lambda i: list_contains(list_transform(m[i:], lambda x: x.role), 'assistant'))), 0) AS last FROM c),
    p AS (SELECT a.conv_id, CASE WHEN a.last IS NULL THEN a.m ELSE a.m[:a.last] END AS chosen,
                 CASE WHEN a.last IS NULL THEN a.m WHEN b.last IS NULL THEN a.m[:a.last - 1]
                      ELSE list_concat(a.m[:a.last - 1], [b.m[b.last]]) END AS rejected
          FROM l a LEFT JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
    n AS (SELECT *, len(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[:i] = rejected[:i]))::INTEGER AS k FROM p),
    s AS (SELECT conv_id, k, chosen[:k] AS prompt, chosen[k + 1:] AS yes, rejected[k + 1:] AS no FROM n)
    SELECT conv_id, k AS n_prompt_turns, sha256(coalesce({_RENDERED.format("prompt")}, '')) AS prompt_sha256,
           sha256(coalesce({_RENDERED.format("yes")}, '')) AS chosen_sha256, {_LEARNED.format("yes")} AS chosen_masked,
           sha256(coalesce({_RENDERED.format("no")}, '')) AS rejected_sha256, {_LEARNED.format("no")} AS rejected_masked
    FROM s""",
)
def op6_preferences(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm.chat import format_preferences, sibling_pairs

    rows = format_preferences(sibling_pairs(table(spark, folder, "conversations")))
    digest = {f"{c}_sha256": F.sha2(F.encode(t, "UTF-8"), 256) for c, t in (("prompt", "prompt"), ("chosen", "chosen_text"), ("rejected", "rejected_text"))}
    return rows.withColumns(digest).select(
        "conv_id", "n_prompt_turns", "prompt_sha256", "chosen_sha256", _masked("chosen_mask").alias("chosen_masked"),
        "rejected_sha256", _masked("rejected_mask").alias("rejected_masked"),
    )


_PLACED = """list_transform(range(1, len(m_{0}) + 1), lambda i: struct_pack(
    s := (coalesce(list_sum(list_transform(g_{0}[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m_{0}[:i - 1], lambda x: length(x))), 0))::BIGINT,
    t := m_{0}[i]))"""
_HOT = """
    h_{kind} AS (SELECT row, s, p, row_number() OVER (PARTITION BY row, s ORDER BY p) AS k,
                        max(p) OVER (PARTITION BY row, s ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
                 FROM (SELECT row, s, unnest(list_filter(range(0, length(t) - {width} + 1), lambda p:
                         regexp_full_match(substr(t, p + 1, {width}), '[{cls}]+')
                         AND length(regexp_replace(substr(t, p + 1, {width}), '[^0-9]', '', 'g')) BETWEEN 2 AND {width} - 2
                         AND list_sum(list_transform(list_distinct(string_split(substr(t, p + 1, {width}), '')), lambda c:
                               round((length(substr(t, p + 1, {width})) - length(replace(substr(t, p + 1, {width}), c, '')))
                                     * log2(length(substr(t, p + 1, {width})) - length(replace(substr(t, p + 1, {width}), c, ''))) * 1000000))) <= {most})) AS p
                       FROM c)),
    r_{kind} AS (SELECT row, s, min(p) AS first, max(p) + {width} AS last
                 FROM (SELECT *, sum(CASE WHEN before IS NULL OR before + {width} < p THEN 1 ELSE 0 END) OVER (PARTITION BY row, s ORDER BY p) AS part FROM h_{kind})
                 GROUP BY row, s, part)"""


def _secret_sql() -> str:
    from tallyflow.llm import secret_scan as scan

    names = {"entropy_hex": "0-9a-f", "entropy_upper": "0-9A-Z", "entropy_mixed": "0-9a-zA-Z+/_-"}
    hot = ",".join(_HOT.format(kind=c.kind, width=c.window, most=c.most, cls=names[c.kind]) for c in scan.CLASSES)
    patterns = {"assign": scan.ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "c": scan.CANDIDATE.replace("{20,4096}", "+")}
    quoted = {k: "'" + v.replace("'", "''") + "'" for k, v in patterns.items()}
    found = ", ".join(f"regexp_extract_all(text, {p}) AS m_{k}, regexp_split_to_array(text, {p}) AS g_{k}" for k, p in quoted.items())
    allowed = " OR ".join(f"regexp_matches(t, '{p}')" for p in scan.ALLOWED)
    least = {"assign": f"length(regexp_extract(t, {quoted['assign']}, 2)) >= 12", "access": "length(t) >= 18", "hex": "length(t) >= 16"}
    base = " UNION ALL ".join(
        f"SELECT row, '{k}' AS kind, {n} AS place, s, s + length(t) AS e FROM (SELECT row, x.s AS s, x.t AS t FROM (SELECT row, unnest(p_{k}) AS x FROM b)) WHERE {least[k]}"
        for n, k in enumerate(least)
    )
    more = " UNION ALL ".join(f"SELECT row, '{c.kind}', {n}, s + first, s + last FROM r_{c.kind}" for n, c in enumerate(scan.CLASSES, 3))
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    a AS (SELECT row, {found} FROM d),
    b AS (SELECT row, {', '.join(f"{_PLACED.format(k)} AS p_{k}" for k in quoted)} FROM a),
    c AS (SELECT row, x.s AS s, x.t AS t FROM (SELECT row, unnest(p_c) AS x FROM b)
          WHERE length(x.t) BETWEEN 20 AND 4096 AND regexp_matches(x.t, '[0-9]') AND regexp_matches(x.t, '[A-Za-z]') AND NOT ({allowed.replace('(t,', '(x.t,')})),
    {hot},
    base AS ({base}), every AS (FROM base UNION ALL {more}),
    n AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                 {text} AS t FROM base GROUP BY row),
    o AS (SELECT row, {text} AS t FROM every GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(n.t, '')) AS base_sha256, coalesce(o.t, '') AS spans
    FROM d LEFT JOIN n USING (row) LEFT JOIN o USING (row)"""


@query("op11_secrets", _secret_sql())
def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm import secret_scan as scan

    return scan.scan(table(spark, folder, "documents")).select(
        "doc_id",
        *(scan.count("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(F.encode(scan.listed("base"), "UTF-8"), 256).alias("base_sha256"),
        scan.listed("spans").alias("spans"),
    )


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(
    "op12_ranking",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ts
               FROM documents WHERE text IS NOT NULL),
    c AS (SELECT count(*)::BIGINT AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0),
    e AS (SELECT row, t, count(*)::BIGINT AS tf FROM (SELECT row, unnest(ts) AS t FROM d) GROUP BY ALL),
    w AS (SELECT t, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM e, c GROUP BY t, nn),
    m AS (SELECT row, doc_id, 100 - 25 + ((25 * len(ts)::BIGINT * nn) // ll) AS m FROM d, c WHERE len(ts) > 0),
    q AS (SELECT item, item_id, t, count(*)::BIGINT AS n
          FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM benchmark)
          GROUP BY ALL),
    s AS (SELECT item, item_id, row, doc_id, sum(n * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
          FROM q JOIN w USING (t) JOIN e USING (t) JOIN m USING (row) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s WHERE score > 0)
    SELECT item_id, k::INTEGER AS rank, doc_id, score FROM r WHERE k <= 20""",
)
def op12_ranking(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm.ranking import rank_documents

    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_CRC32 = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda r, x:
    list_reduce(list_concat([xor(r, x)], list_transform(range(8), lambda k: 0::BIGINT)), lambda v, z: xor(v // 2, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))"""


@query(
    "op13_prefix_trie",
    f"""
    WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
                      struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS m FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT c, list(m ORDER BY k) AS ms FROM o GROUP BY c),
    h AS (SELECT c, ms, xor({_CRC32}, 4294967295) % 9 AS h FROM t),
    r AS (SELECT h.c, list_concat(coalesce(b.ms, [])[:h], h.ms[h + 1:]) AS ms FROM h LEFT JOIN t b ON b.c = h.c - h.c % 5),
    p AS (SELECT c, ms, len(ms) AS n, unnest(range(0, len(ms) + 1)) AS d FROM r),
    x AS (SELECT c, n, d, ms[:d] AS key, CASE WHEN d > 0 THEN strlen(ms[d].text) ELSE 0 END AS bytes, ms[:d - 1] AS up FROM p),
    g AS (SELECT d, key, CASE WHEN d > 0 THEN any_value(up) END AS up, min(c) AS c, count(*) AS n_convs, any_value(bytes) AS bytes,
                 string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends FROM x GROUP BY d, key),
    j AS (SELECT g.*, a.c AS parent FROM g LEFT JOIN g a ON a.d = g.d - 1 AND a.key = g.up),
    f AS (SELECT j.*, (SELECT count(*) FROM j y WHERE y.d = j.d + 1 AND y.up = j.key) AS n_children FROM j),
    s AS (SELECT a.d, a.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.bytes)::BIGINT AS saved
          FROM f JOIN x a ON a.c = f.c AND a.d <= f.d GROUP BY a.d, a.key)
    SELECT f.c AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved AS saved_tokens,
           sha256(coalesce(f.ends, '')) AS ends_sha256 FROM f JOIN s ON s.d = f.d AND s.key = f.key""",
)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from tallyflow.llm.prefix_trie import trie

    return trie(table(spark, folder, "conversations"))
