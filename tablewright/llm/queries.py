"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import cuckoo, dac, disclosure, langid, lexical, linespread, mixing, nearcopies, pieces, topk, toxicity, turns, warc
from tablewright.llm.common import held_out, scratch
from tablewright.llm.repair_sql import REPAIR_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "op1_arc_to_warc",
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest,
               CAST(strlen(coalesce(html, '')) AS BIGINT) AS size
        FROM pages
    ), f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
    SELECT page_id, size AS payload_bytes, p.digest AS payload_digest,
           CASE WHEN first IS NULL OR page_id IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END
               AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM p LEFT JOIN f ON p.digest = f.digest AND size >= 100
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files, converted to WARC and read back."""
    arcs, warcs = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(table(spark, sf_dir, "pages"), arcs)
    warc.arc_to_warc(spark, arcs, warcs)
    return warc.read_records(spark, warcs).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@register("op2_token_codes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as directly addressable token codes, read back."""
    path = scratch(spark, "tokens")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    dac.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer, end_id=1)
    return dac.read_documents(spark, path)


@register(
    "op3_cuckoo_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
    FROM d JOIN g USING (text_sha256)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cuckoo.find_copies(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@register("op4_fair_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@register("op5_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.digests(pieces.encode(docs, model, decoded="decoded"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= toxicity.LEVEL).cast("int"))


@register(
    "op7_top_products",
    """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), p AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        WHERE q.vec_id % 50 = 0
    ), r AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM p
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@register("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    return langid.identify(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])


@register(
    "op9_line_spread",
    """
    WITH a AS (
        SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
    ), l AS (
        SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM a
    ), n AS (
        SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS name FROM l
    ), s AS (
        SELECT name FROM n WHERE name <> '' GROUP BY name HAVING count(DISTINCT source) >= 5
    ), m AS (
        SELECT n.doc_id, n.pos, n.line, s.name IS NOT NULL AS gone FROM n LEFT JOIN s ON n.name = s.name
    ), d AS (
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
        FROM m GROUP BY doc_id
    )
    SELECT a.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS clean_sha256
    FROM a LEFT JOIN d ON a.doc_id = d.doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on five sources or more."""
    cleaned = linespread.drop_spread_lines(table(spark, sf_dir, "documents"), min_sites=5)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return cleaned.select("doc_id", "n_lines", "n_removed", digest.alias("clean_sha256"))


@register(
    "op10_near_copies",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS ws
        FROM documents
    ), s AS (
        SELECT doc_id, list_distinct(CASE
            WHEN len(ws) >= 4
                THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')]
            ELSE [] END) AS sh
        FROM w
    ), f AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
    ), c AS (
        SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
        FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), e AS (SELECT a, b FROM c WHERE 100 * i >= 80 * (na + nb - i)
    ), two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
    ), r(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT r.doc_id, two.b FROM r JOIN two ON r.other = two.a
    ), m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
    SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
    FROM s JOIN m ON s.doc_id = m.doc_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.find_near_copies(table(spark, sf_dir, "documents"), words=4, percent=80)


@register("op11_turn_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired by the cheapest edits."""
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")), copies="copies")


@register(
    "op12_lexical_search",
    r"""
    WITH d AS (
        SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
        FROM documents
    ), c AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS words FROM d WHERE len(ws) > 0
    ), b AS (
        SELECT item_id, text, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)
    ), i AS (SELECT item_id, text, term, count(*) AS times FROM b GROUP BY ALL
    ), p AS (
        SELECT row, doc_id, n, term, count(*) AS tf
        FROM (SELECT row, doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d)
        WHERE term IN (SELECT term FROM i) GROUP BY ALL
    ), w AS (
        SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c
    ), s AS (
        SELECT item_id, text, row, doc_id,
               sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
        FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
        FROM s WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@register(
    "op13_disclosure",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
    ), m AS (
        SELECT row, t, 1 AS ord, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS ms,
               string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gs FROM d
        UNION ALL
        SELECT row, t, 2, 'ip', regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
               string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
        UNION ALL
        SELECT row, t, 3, 'card', regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'),
               string_split_regex(t, '[0-9]([\x20-]?[0-9])+') FROM d
        UNION ALL
        SELECT row, t, 4, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'),
               string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
    ), u AS (
        SELECT row, t, ord, kind, unnest(ms) AS found,
               unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0)
                   + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0)))::BIGINT AS start
        FROM m WHERE len(ms) > 0
    ), v AS (
        SELECT *, start + length(found) AS stop, regexp_replace(found, '[^0-9]', '', 'g') AS digits FROM u
    ), e AS (
        SELECT *, coalesce(lag(stop) OVER w, 0) AS before, coalesce(lead(start) OVER w, length(t)) AS after
        FROM v WHERE kind <> 'card' OR length(digits) BETWEEN 16 AND 19
        WINDOW w AS (PARTITION BY row, kind ORDER BY start)
    ), base AS (
        SELECT row, ord, kind, start, stop,
               CASE kind WHEN 'email' THEN lower(found) WHEN 'ip' THEN found ELSE digits END AS value,
               t[before + 1:start] AS lead_text, t[stop + 1:after] AS tail_text
        FROM e
        WHERE kind = 'email'
           OR (kind = 'phone' AND length(digits) BETWEEN 8 AND 15)
           OR (kind = 'ip' AND len(list_filter(string_split(found, '.'), lambda x: length(ltrim(x, '0')) > 3
               OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0)
           OR (kind = 'card' AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
               CASE WHEN i % 2 = 1 THEN digits[-i]::INTEGER ELSE digits[-i]::INTEGER * 2 - CASE WHEN digits[-i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0)
    ), near AS (
        SELECT kind, value, count(*) AS times,
               CASE WHEN length(lead_text) > 80 THEN regexp_replace(right(lead_text, 80), '^[\p{L}\p{N}]+', '') ELSE lead_text END
               || ' ' || CASE WHEN length(tail_text) > 80 THEN regexp_replace(left(tail_text, 80), '[\p{L}\p{N}]+$', '') ELSE tail_text END AS context
        FROM base GROUP BY ALL
    ), contexts AS (
        SELECT kind, value, times, context, unnest(list_filter(regexp_extract_all(lower(regexp_replace(context,
            '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', ' ', 'g')), '[\p{L}\p{N}]+'), lambda x: length(x) > 2 AND regexp_matches(x, '^\p{L}'))) AS term
        FROM near
    ), pairs AS (
        SELECT kind, value, term, sum(times) AS together FROM contexts GROUP BY ALL HAVING count(DISTINCT context) >= 3
    ), words AS (
        SELECT row, list_filter(regexp_extract_all(lower(regexp_replace(t,
            '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', ' ', 'g')), '[\p{L}\p{N}]+'), lambda x: length(x) > 2 AND regexp_matches(x, '^\p{L}')) AS ws
        FROM d
    ), counts AS (SELECT term, count(*) AS times FROM (SELECT unnest(ws) AS term FROM words) GROUP BY term
    ), told AS (
        SELECT DISTINCT term FROM pairs JOIN counts USING (term) WHERE log2(times / together) <= 0.5
    ), holders AS (
        SELECT DISTINCT row FROM (SELECT row, unnest(ws) AS term FROM words) WHERE term IN (SELECT term FROM told)
    ), r AS (
        SELECT row, regexp_extract_all(t, '[\p{L}\p{N}]+') AS ms, string_split_regex(t, '[\p{L}\p{N}]+') AS gs
        FROM d WHERE row IN (SELECT row FROM holders)
    ), places AS (
        SELECT row, unnest(ms) AS found,
               unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda g: length(g)))
                   + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0)))::BIGINT AS start
        FROM r
    ), added AS (
        SELECT row, 5 AS ord, 'term' AS kind, start, start + length(found) AS stop FROM places p
        WHERE lower(found) IN (SELECT term FROM told)
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = p.row AND b.start < p.start + length(p.found) AND p.start < b.stop)
    ), spans AS (SELECT row, ord, kind, start, stop FROM base UNION ALL SELECT * FROM added
    ), s AS (
        SELECT row, count(*) FILTER (WHERE ord = 1) AS n_email, count(*) FILTER (WHERE ord = 2) AS n_ip,
               count(*) FILTER (WHERE ord = 3) AS n_card, count(*) FILTER (WHERE ord = 4) AS n_phone,
               count(*) FILTER (WHERE ord = 5) AS n_term,
               string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) AS spans,
               string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) FILTER (WHERE ord < 5) AS base
        FROM spans GROUP BY row
    )
    SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
           coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_term, 0) AS n_term
    FROM d LEFT JOIN s USING (row)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, in every document."""
    found = disclosure.report(disclosure.find_private(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"
    )
