"""SQL that other engines run to the same results as the queries, where SQL can say it."""

from __future__ import annotations

from lodestone.llm import divergence as d
from lodestone.llm import mixing as m


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op2() -> str:
    own = " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in d.COMMON_WORDS.items())
    patterns = [r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"\p{Nd}+", r"[.,;:!?''\"()\-]+", r"[\p{S}\p{P}]+"]
    steps, last = [], "whole"
    for k, p in enumerate(patterns):
        steps.append(f"c{k} AS (SELECT *, regexp_replace(t{k}, '{p}', '', 'g') AS t{k + 1} FROM {last})")
        last = f"c{k}"
    counts = ", ".join([*(f"length(t{k}) - length(t{k + 1})" for k in range(6)), "length(t6)"])

    def term(p: str, q: str) -> str:
        mid = f"(({p} + {q}) / 2)"
        return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {mid}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {mid}) ELSE 0 END)"

    def distance(have: str, ref: str, n: int) -> str:
        each = " + ".join(term(f"({have}[{i}] / greatest(list_sum({have}), 1))", f"{ref}[{i}]") for i in range(1, n + 1))
        return f"sqrt(greatest(({each}) / 2, 0))"

    def reference(name: str, n: int) -> str:
        return "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"

    return f"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS t0, {WORDS} AS w, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in d.COMMON_WORDS)}) THEN lang ELSE 'und' END AS lang FROM documents),
{", ".join(steps)},
counted AS (SELECT doc_id, t0, w, lang, CAST(len(w) AS BIGINT) AS n_words, length(t0) - (length(t1) - length(t2)) AS word_chars,
  length(t1) - length(regexp_replace(t1, '[#*$%&|<>]+', '', 'g')) AS n_symbols, [{counts}] AS cls,
  CASE lang {own} ELSE list_transform(range(15), lambda i: chr(1)) END AS own, list_transform(w, lambda x: lower(x)) AS low FROM c5),
commons AS (SELECT *, list_transform(own, lambda o: len(list_filter(low, lambda x: x = o))) AS hits, len(list_filter(low, lambda x: list_contains(own, x))) AS n_hits FROM counted),
shared AS (SELECT *, list_concat(hits, [n_words - n_hits]) AS com FROM commons),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(t0, chr(10))) AS l FROM whole) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM whole)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_rep FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
feats AS (SELECT s.doc_id, s.lang, n_words, word_chars, n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words,
  list_transform(cls, lambda x: CAST(floor(x * {d.UNIT} / greatest(list_sum(cls), 1)) AS BIGINT)) AS p, list_transform(com, lambda x: CAST(floor(x * {d.UNIT} / greatest(list_sum(com), 1)) AS BIGINT)) AS q
  FROM shared s LEFT JOIN lines l ON l.doc_id = s.doc_id LEFT JOIN covered c ON c.doc_id = s.doc_id),
refs AS (SELECT lang, list_transform(a, lambda x: x / greatest(list_sum(a), 1)) AS rp, list_transform(b, lambda x: x / greatest(list_sum(b), 1)) AS rq FROM (SELECT lang, {reference("p", 7)} AS a, {reference("q", 16)} AS b FROM feats WHERE n_words >= {d.MIN_WORDS_CLASSES} GROUP BY lang)),
judged AS (SELECT f.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words >= {d.MIN_WORDS_CLASSES} THEN {distance("p", "rp", 7)} ELSE 0 END AS dp,
  CASE WHEN n_words >= {d.MIN_WORDS_COMMON} AND f.lang <> 'und' THEN {distance("q", "rq", 16)} ELSE 0 END AS dq FROM feats f LEFT JOIN refs r ON r.lang = f.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND dp <= {d.MAX_CLASS_DISTANCE} AND dq <= {d.MAX_COMMON_DISTANCE} AS kept FROM judged"""


def op6() -> str:
    bits = (1 << (m.LEVEL_BITS * m.LEVELS)) - 1
    return f"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 8) AS BIGINT) & {bits} AS h FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * s AS cap FROM sums),
filled AS (SELECT *, CAST(sum(s) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER before AS BIGINT), 0) AS rest, CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER before AS BIGINT), 0) AS share
  FROM weighed WINDOW before AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open_ AS (SELECT arg_min(rest, cap / w) AS rest, max(share) AS share, min(cap / w) AS ratio FROM filled WHERE cap * share >= w * rest),
aims AS (SELECT f.source, f.s, CASE WHEN f.cap * o.share < f.w * o.rest THEN CAST(f.cap AS DOUBLE) ELSE f.w * CAST(o.rest AS DOUBLE) / o.share END AS target FROM filled f, open_ o),
plan AS (SELECT *, CASE WHEN s > 0 THEN least(CAST(floor(target / s) AS BIGINT), 3) ELSE 0 END AS whole FROM aims),
placed AS (SELECT d.*, p.s, p.target, p.whole, p.target - p.whole * p.s AS budget FROM sized d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source),
cells AS (SELECT source, budget, h, sum(size) AS cell FROM placed GROUP BY 1, 2, 3),
run AS (SELECT *, sum(cell) OVER (PARTITION BY source ORDER BY h) AS upto FROM cells),
edges AS (SELECT source, min(h) + CASE WHEN 2 * arg_min(budget - (upto - cell), h) >= arg_min(cell, h) THEN 1 ELSE 0 END AS edge FROM run WHERE upto > budget GROUP BY source)
SELECT p.doc_id, p.size, p.s AS source_size, p.target, p.size * (p.whole + CASE WHEN p.h < coalesce(e.edge, CASE WHEN p.budget > 0 THEN {bits + 1} ELSE 0 END) THEN 1 ELSE 0 END) AS taken
FROM placed p LEFT JOIN edges e ON e.source IS NOT DISTINCT FROM p.source"""


def op8() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def op11() -> str:
    return r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM n"""


def op13() -> str:
    failing = " || ".join(
        f"CASE WHEN {test} THEN '{name}' ELSE '' END"
        for name, test in {
            "A": "len(w) < 200", "B": "100 * len(list_distinct(w)) < 50 * len(w)", "C": "100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t)",
            "D": "regexp_matches(t, '[#$%&*|]')", "E": "coalesce(doc_id > least_id, false)",
        }.items()
    )
    return f"""
WITH base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id FROM documents),
cells AS (SELECT part, {failing} AS fails, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM base),
sums AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM cells GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
gone AS (SELECT s.*, filter_order, CASE WHEN fails = '' THEN 6 ELSE list_min(list_transform(string_split(fails, ''), lambda c: strpos(filter_order, c))) END AS gone_at FROM sums s, orders),
figures AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, CAST(sum(CASE WHEN gone_at > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone_at < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN gone_at = step THEN g ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN gone_at = step THEN x ELSE 0 END) AS BIGINT) AS toxic_lost FROM gone, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM figures"""
