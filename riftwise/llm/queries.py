"""Queries that apply each operator to its whole table, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, mixing, quality_model, quality_rules, simhash, suffix_dedup, syncmers, url_filter, warc
from .common import read, shared_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                        F.col("n_removed").cast("long").alias("n_removed"),
                        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_model.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"),
                        F.round("tail_1", 6).alias("tail_1"), F.round("tail_2", 6).alias("tail_2"), "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(read(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_line_dedup, op3_quality_classifier, op4_suffix_dedup,
                                    op5_fingerprints, op6_mixing, op7_bpe, op8_warc, op9_quality_rules,
                                    op10_url_filter)}


WORD = r"[^\x20\x09-\x0D]+"


def _op6_sql() -> str:
    m = mixing
    bits = lambda *x: f"(('0x' || substr(md5(concat_ws(':', {', '.join(x)})), 1, 8))::BIGINT & 2147483647)"
    name = "coalesce(source, '~')"
    steps = []
    for r in range(1, m.ROUNDS + 1):  # each round by itself, so that its columns are computed once
        y = f"(({bits(name, 'pass', str(r), "'k'")} % blocks) - v + blocks) % blocks"
        h = f"((greatest(v, y) % {m.PRIME} + {bits(name, 'pass', str(r), "'a'")}) % {m.PRIME})"
        steps.append(f"""
y{r} AS MATERIALIZED (SELECT *, {y} AS y FROM v{r - 1}),
v{r} AS MATERIALIZED (SELECT sid, source, blocks, pass, CASE WHEN ({h} * {h} % {m.PRIME} * 48271 % {m.PRIME}) >> 16 & 1 = 1
  THEN y ELSE v END AS v FROM y{r}),""")
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         {bits("doc_id::VARCHAR")} AS d FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS sid,
         [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap FROM src),
filled AS (
  SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS all_words,
         coalesce(sum(cap) OVER before, 0) AS filled,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM ranked WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((all_words - filled) / open) AS l FROM filled WHERE (all_words - filled) / open <= ratio),
plan AS (
  SELECT sid, source, source_size, docs, least(cap, coalesce(l, 'inf'::DOUBLE) * weight) AS target,
         ceil(source_size / {m.BLOCK})::BIGINT AS blocks FROM filled, level),
shares AS (SELECT *, floor(target * blocks / source_size * {m.PARTS} + 0.5)::BIGINT AS share FROM plan WHERE source_size > 0),
wholes AS (SELECT sum(share)::BIGINT AS whole, (sum(share)::BIGINT + {m.PARTS // 2}) // {m.PARTS} AS slots FROM shares),
shards AS (SELECT unnest(range((slots + {m.SHARD - 1}) // {m.SHARD})) AS shard, whole, slots FROM wholes),
shard_sizes AS (SELECT shard, whole, least({m.SHARD}, slots - shard * {m.SHARD})::BIGINT AS n FROM shards),
parts AS (
  SELECT shard, n, sid, n * share // whole AS given, floor((n * share % whole) / whole::DOUBLE * {m.FINE})::BIGINT AS part
  FROM shard_sizes, shares),
bounds AS (SELECT *, (sum(part) OVER (PARTITION BY shard ORDER BY sid))::BIGINT AS hi, (sum(part) OVER (PARTITION BY shard))::BIGINT AS total,
                  (n - sum(given) OVER (PARTITION BY shard))::BIGINT AS open FROM parts),
draws AS (SELECT shard, total, unnest(range(1, open + 1)) AS i FROM (SELECT DISTINCT shard, total, open FROM bounds)),
drawn AS (SELECT shard, {bits("'shard'", "shard", "i")} % total AS v FROM draws),
counts AS (
  SELECT shard, sid, sum(n)::BIGINT AS n FROM (
    SELECT shard, sid, given AS n FROM bounds UNION ALL
    SELECT shard, sid, 1 FROM drawn d JOIN bounds b USING (shard) WHERE v < hi AND v >= hi - part) GROUP BY shard, sid),
slots AS (
  SELECT sid, unnest(range(f, f + n)) AS q FROM (
    SELECT *, (sum(n) OVER (PARTITION BY sid ORDER BY shard) - n)::BIGINT AS f FROM counts)),
v0 AS MATERIALIZED (
  SELECT sid, source, blocks, q // blocks AS pass, q % blocks AS v FROM slots JOIN plan USING (sid)
  WHERE q < {int(m.MOST)} * blocks),{"".join(steps)}
uses AS (SELECT sid, v AS block, count(*) AS uses FROM v{m.ROUNDS} GROUP BY ALL),
placed AS (
  SELECT s.doc_id, p.sid, s.size, coalesce(sum(s.size) OVER (
           PARTITION BY p.sid ORDER BY s.d % ceil(sqrt(p.docs))::BIGINT, s.d, s.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
cuts AS (
  SELECT *, unnest(range(start // {m.BLOCK}, (start + size - 1) // {m.BLOCK} + 1)) AS block
  FROM placed WHERE size > 0),
taken AS (
  SELECT doc_id, sum(uses * (least(c.size, (c.block + 1) * {m.BLOCK} - start)
                             - greatest(0, c.block * {m.BLOCK} - start)))::BIGINT AS taken
  FROM cuts c JOIN uses u ON c.sid = u.sid AND c.block = u.block GROUP BY doc_id)
SELECT s.doc_id, s.size, p.source_size, p.target, coalesce(t.taken, 0) AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN taken t USING (doc_id)"""


OP8_SQL = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM rows),
best AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM hashed)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM best"""


def _op9_sql() -> str:
    ratio = lambda m: f"({m.split(' / ')[0]}::DOUBLE / greatest({m.split(' / ')[1]}, 1))"
    steps = list(enumerate(quality_rules.STEPS, 1))
    p, limit = quality_rules.RISK, f"{quality_rules.ERROR} / (SELECT count(*) FROM sums)"
    tail = lambda k: (f"(CASE WHEN {k} > n * {p} THEN 1 ELSE list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1)"  # noqa: E731
                      f" - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) END)")
    level = "coalesce(" + ", ".join(f"CASE WHEN {ratio(m)} * {s} > {c} * {s} THEN {j} END" for j, (m, s, c) in steps) + ")"
    sums = ", ".join(f"count(*) FILTER (level <= {j}) AS k{j}" for j, _ in steps)
    passed = ", ".join(f"CASE WHEN {tail(f'k{j}')} <= {limit} THEN {j} ELSE 0 END" for j, _ in steps)
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{WORD}')) AS l FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
win AS (
  SELECT doc_id, i, [word, lead(word, 1) OVER x, lead(word, 2) OVER x, lead(word, 3) OVER x, lead(word, 4) OVER x] AS g
  FROM pos WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM win WHERE g[5] IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {level} AS level FROM m),
sums AS (
  SELECT stratum, count(*) AS n, {sums} FROM b JOIN labels USING (doc_id)
  WHERE NOT base_failed AND quality = 1 GROUP BY stratum),
certified AS (SELECT stratum, greatest({passed}) AS steps FROM sums)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(level <= steps, false)) AS kept
FROM b LEFT JOIN certified USING (stratum)"""


def _op10_sql() -> str:
    fits = "\n".join(
        f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '/{rest}') THEN '{n}/{rest}'"
        for n, _, rest in (r[1].partition("/") for r in sorted(url_filter.RULES, key=lambda r: -len(r[1]))))
    verdicts = "\n".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in url_filter.RULES)
    u, levels = url_filter, []
    for d in range(u.DEPTH):
        levels.append(f"""
k{d} AS MATERIALIZED (
  SELECT host, branch, segs[{d + 1}] AS seg, sum(pages)::BIGINT AS pages, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad
  FROM t{d} WHERE len(segs) > {d} GROUP BY ALL),
s{d} AS (SELECT host, branch, count(*) AS kids, sum(n)::BIGINT AS nn, sum(bad)::BIGINT AS bb FROM k{d} GROUP BY ALL),
w{d} AS MATERIALIZED (
  SELECT host, branch, seg FROM k{d} JOIN s{d} USING (host, branch)
  WHERE kids > 1 AND (kids > {u.FANOUT} AND pages < {u.THIN} OR CASE WHEN n >= {u.LEAST} AND nn - n >= {u.LEAST} THEN
    (bad / n - (bb - bad) / (nn - n)) * (bad / n - (bb - bad) / (nn - n))
    <= (bb / nn) * (1 - bb / nn) * (1.0::DOUBLE / n + 1.0::DOUBLE / (nn - n)) * {u.Z * u.Z}::DOUBLE ELSE false END)),
t{d + 1} AS MATERIALIZED (
  SELECT t.host, t.segs, pages, n, bad, CASE WHEN len(segs) > {d}
    THEN list_append(t.branch, CASE WHEN w.host IS NULL THEN segs[{d + 1}] ELSE '*' END) ELSE t.branch END AS branch
  FROM t{d} t LEFT JOIN w{d} w ON t.host = w.host AND t.branch = w.branch AND t.segs[{d + 1}] = w.seg),""")
    return rf"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
cut AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS whole FROM parsed),
x AS (
  SELECT page_id, host, path, list_transform(
    CASE WHEN len(whole) > {u.DEPTH} THEN list_append(whole[:{u.DEPTH - 1}], array_to_string(whole[{u.DEPTH}:], '/')) ELSE whole END,
    lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' || regexp_extract(s, '(\.[A-Za-z]+)$', 1) ELSE s END) AS segs FROM cut),
rated AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT host, segs, count(*) AS pages, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad
  FROM x LEFT JOIN rated ON page_id = doc_id GROUP BY host, segs),
t0 AS MATERIALIZED (SELECT *, []::VARCHAR[] AS branch FROM counts),{"".join(levels)}
named AS (SELECT *, array_to_string(branch, '/') AS template FROM t{u.DEPTH}),
base AS (SELECT coalesce(sum(bad), 0) / greatest(sum(n), 1) AS base FROM counts),
hosts AS (
  SELECT host, (sum(bad) + any_value(base) * {u.STRENGTH}) / (sum(n) + {u.STRENGTH}) AS host_share FROM counts, base GROUP BY host),
shares AS (
  SELECT n.host, template, (sum(bad) + any_value(host_share) * {u.STRENGTH}) / (sum(n) + {u.STRENGTH}) AS bad_share
  FROM named n JOIN hosts ON n.host = hosts.host GROUP BY n.host, template),
ruled AS (
  SELECT page_id, x.host, path, bad_share, CASE {fits} END AS rule
  FROM x JOIN named USING (host, segs) JOIN shares ON x.host = shares.host AND named.template = shares.template)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN bad_share > {u.PURITY} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": _op6_sql(), "op8_warc": OP8_SQL, "op9_quality_rules": _op9_sql(), "op10_url_filter": _op10_sql()}
