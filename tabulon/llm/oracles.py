"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .mixing import Mix
from .quality import SIGNALS, RiskPolicy
from .urls import LOWER, RULES, SECOND_LEVEL, UPPER

SPACES = r"[\x20\x09-\x0D]+"


def quality_sql(policy: RiskPolicy = RiskPolicy()) -> str:
    rate = policy.alpha / len(SIGNALS)
    cells = ", ".join(f"({c!r}::double)" for c in policy.grid)
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN least({a}::double / {b}, 1.0) ELSE 0.0 END"
    limits = ", ".join(f"min(CASE WHEN signal = '{s}' THEN cutoff END) AS max_{s}" for s in SIGNALS)
    above = " OR ".join(f"coalesce({s} > max_{s}, false)" for s in SIGNALS)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS stratum FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '{SPACES}'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid
), c AS (
  SELECT w.rid, doc_id, stratum, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines,
    coalesce(n, 0)::bigint AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z!]', '', 'g')) AS n_shout
  FROM w LEFT JOIN covered USING (rid)
), s AS (
  SELECT *, {share("n_symbols", "word_chars")} AS symbol_ratio, {share("n_dup_lines", "n_lines")} AS dup_line_ratio,
    {share("n_repeat_words", "n_words")} AS repeat_ratio, {share("n_shout", "word_chars")} AS shout_ratio FROM c
), good AS (
  SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), held AS (
  SELECT stratum, good, signal, value FROM (SELECT * FROM s JOIN good USING (doc_id)) UNPIVOT (value FOR signal IN ({", ".join(SIGNALS)}))
), k AS (
  SELECT stratum, signal, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND value > cutoff) AS k
  FROM held, (VALUES {cells}) AS grid(cutoff) GROUP BY ALL
), p AS (
  SELECT *, (SELECT count(DISTINCT stratum) FROM k) AS strata, CASE WHEN k > n * {rate!r} THEN 1.0 ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r})))) END AS tail
  FROM k WHERE n > 0
), passed AS (
  SELECT stratum, signal, cutoff, bool_and(tail <= {policy.delta / len(SIGNALS)!r} / strata) OVER (PARTITION BY stratum, signal ORDER BY cutoff DESC) AS ok FROM p
), limits AS (
  SELECT stratum, {limits} FROM passed WHERE ok GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({above}) AS kept
FROM s LEFT JOIN limits USING (stratum)"""


def urls_sql(max_bad: float = 0.5, doubt: float = 0.05) -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')"
    chain = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick((v, h, p))}'" for v, h, p in rules) + " END"
    deep = f"CASE WHEN len(x) >= 3 AND length(x[-1]) = 2 AND x[-2] IN ({', '.join(map(repr, SECOND_LEVEL))}) THEN 2 ELSE 1 END"
    last = lambda more: f"CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN name ELSE array_to_string(x[greatest(len(x) - {deep} + {1 - more}, 1):], '.') END"

    def shrunk(name: str, level: str, parent: str, key: str) -> str:
        return f"""{name}_m AS (SELECT l.*, p.mean AS m FROM {level} l JOIN {parent} p ON l.{key} = p.{key}),
{name}_s AS (SELECT 1 / least(greatest(coalesce(sum(pow(bad - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0), 0.001), 0.001), 0.999) - 1 AS s FROM {name}_m),
{name}_p AS (SELECT * EXCLUDE (m, s), bad + s * m AS a, n - bad + s * (1 - m) AS b, (bad + s * m) / (n + s) AS mean FROM {name}_m, {name}_s),
{name} AS (SELECT *, CASE WHEN mean > {max_bad} THEN list_sum(list_transform(range(0, (10 * sqrt(a + b) + 200)::bigint), lambda i:
    exp(a * ln({max_bad}) + b * ln(1 - {max_bad}) - ln(a) - lgamma(a) - lgamma(b) + lgamma(a + b) + lgamma(a + b + i) - lgamma(a + b) - lgamma(a + 1 + i) + lgamma(a + 1) + i * ln({max_bad})))) ELSE 1 END AS below FROM {name}_p)"""

    return f"""
WITH parsed0 AS (SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages)),
parsed1 AS (SELECT *, string_split(name, '.') AS x FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM parsed0)),
parsed AS (SELECT page_id, url, host, path, {last(1)} AS dom, {last(0)} AS suf FROM parsed1),
judged AS (SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, dom, suf, count(*) AS n, count(*) FILTER (WHERE bad) AS bad FROM parsed JOIN judged ON page_id = doc_id WHERE host <> '' GROUP BY ALL),
top AS (SELECT 0 AS root, (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS mean FROM hosts),
suf0 AS (SELECT 0 AS root, suf, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suf),
{shrunk("sufs", "suf0", "top", "root")},
dom0 AS (SELECT dom, suf, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY dom, suf),
{shrunk("doms", "dom0", "sufs", "suf")},
host0 AS (SELECT host, dom, n, bad FROM hosts),
{shrunk("known", "host0", "doms", "dom")}
SELECT page_id, parsed.host, path, {chain(lambda r: r[1] + r[2]).replace("host", "parsed.host")} AS rule,
  coalesce({chain(lambda r: r[0]).replace("host", "parsed.host")}, CASE WHEN coalesce(known.below, doms.below, sufs.below) < {doubt} THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN known ON parsed.host = known.host LEFT JOIN doms ON parsed.dom = doms.dom LEFT JOIN sufs ON parsed.suf = sufs.suf"""


def mix_sql(mix: Mix = Mix()) -> str:
    def weight(name: str, table: dict) -> str:
        return ("CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {mix.default} END") if table else str(mix.default)

    domain = "CASE " + " ".join(f"WHEN source = '{s}' THEN '{d}'" for s, d in mix.domain_of.items()) + f" ELSE '{mix.rest}' END"

    def filled(name: str, nodes: str, by: str, own: str, keep: str) -> str:
        return f"""{name}_l AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY cap / w, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY {by} ORDER BY cap / w, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ({nodes})),
{name} AS (SELECT {keep}, greatest(CASE WHEN cap / w <= level THEN cap ELSE least(cap, floor(w * arg_min(CASE WHEN cap / w > level THEN level END, CASE WHEN cap / w > level THEN row(cap / w, {own}) END) OVER (PARTITION BY {by}))) END, 0)::bigint AS part FROM {name}_l)"""

    draw = lambda epoch: f"md5('{mix.seed}:' || {epoch} || ':' || doc_id)"
    return f"""
WITH r0 AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, len(list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> ''))::bigint AS n_tokens FROM documents),
r AS (SELECT *, {domain} AS domain FROM r0 WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::double AS tokens, sum(n_tokens)::double * {mix.epochs} AS cap FROM r GROUP BY ALL),
{filled("d", f"SELECT domain, 0 AS root, sum(cap) AS cap, {weight('domain', dict(mix.domains))}::double AS w, (SELECT floor(sum(tokens) * {mix.share} / 1000) FROM leaves) AS budget FROM leaves GROUP BY domain", "root", "domain", "domain")},
{filled("m", f"SELECT domain, lang, sum(cap) AS cap, {weight('lang', dict(mix.langs))}::double AS w, any_value(part) AS budget FROM leaves JOIN d USING (domain) GROUP BY domain, lang", "domain", "lang", "domain, lang")},
{filled("s", f"SELECT domain, lang, source, cap, tokens, {weight('source', dict(mix.sources))}::double AS w, part AS budget FROM leaves JOIN m USING (domain, lang)", "domain, lang", "source", "domain, lang, source, tokens")},
plan AS (SELECT *, floor(part / tokens)::bigint AS epochs, part - floor(part / tokens) * tokens AS rest FROM s),
drawn AS (SELECT *, {draw("epochs")} AS h FROM r JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM drawn)
SELECT doc_id, domain, lang, source, n_tokens, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies
FROM summed WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0"""
