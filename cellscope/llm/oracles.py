"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from cellscope.llm import license_scan, mixing, near_dedup, url_filter, vector_dedup


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- op4: exact shingle sets, exact pairs, components by recursion
NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {near_dedup.WORDS} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+{near_dedup.WORDS - 1}], ' ') END AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {near_dedup.WORDS - 2}))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {near_dedup.SIMILAR[1]}*c >= {near_dedup.SIMILAR[0]}*(x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id"""


# ---- op5
def _rule_case(what) -> str:
    parts = [f"WHEN (host = {_quoted(h)} OR ends_with(host, {_quoted('.' + h)})) AND starts_with(path, {_quoted(p)}) THEN {_quoted(what(h, p, v))}" for h, p, v in sorted(url_filter.RULES, key=lambda r: (len(r[0] + r[1]), r), reverse=True)]
    return "CASE " + " ".join(parts) + " END"


def _strength(table: str, name: str) -> str:
    return f"""{name}0 AS (SELECT CAST(sum(n) AS DOUBLE) AS N, CAST(sum(bad) AS DOUBLE) AS X, CAST(count(*) AS DOUBLE) AS M, CAST(sum(n*n) AS DOUBLE) AS N2, sum(bad*bad/CAST(n AS DOUBLE)) AS X2 FROM {table} WHERE n > 0),
{name}1 AS (SELECT *, coalesce(X/nullif(N, 0), 0) AS mu FROM {name}0), {name}2 AS (SELECT *, ((X2 - N*mu*mu)/nullif(mu*(1-mu), 0) - (M-1))/nullif(N - N2/nullif(N, 0) - (M-1), 0) AS rho FROM {name}1),
{name} AS (SELECT mu, coalesce(CASE WHEN rho > 0 THEN least(1000, greatest(1, 1/rho - 1)) ELSE 1000 END, 1000) AS k FROM {name}2)"""


URLS = f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host FROM u),
x AS (SELECT page_id, host, regexp_extract(substr(coalesce(rest, ''), length(host) + 1), '^[^?#]*') AS path FROM h),
mk AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
oh AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM (SELECT DISTINCT page_id, host FROM x) LEFT JOIN mk USING (page_id) GROUP BY host),
op AS (SELECT *, regexp_matches(name, '^[0-9.]+$') AS num, array_to_string(string_split(name, '.')[-2:], '.') AS two FROM oh),
o AS (SELECT host, n, bad, CASE WHEN num THEN name WHEN two IN {url_filter.SUFFIXES!r} THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain, CASE WHEN num THEN name WHEN two IN {url_filter.SUFFIXES!r} THEN two ELSE string_split(name, '.')[-1] END AS suffix FROM op),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM o GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
{_strength('s', 'ks')}, {_strength('d', 'kd')}, {_strength('o', 'kh')},
ms AS (SELECT suffix, (bad + k*mu)/(n + k) AS m FROM s, ks), md AS (SELECT domain, (bad + k*ms.m)/(n + k) AS m FROM d JOIN ms USING (suffix), kd),
mh AS (SELECT host, (bad + k*md.m)/(n + k) AS mean, n + k AS w FROM o JOIN md USING (domain), kh)
SELECT page_id, host, path, {_rule_case(lambda h, p, v: h + p)} AS rule, coalesce({_rule_case(lambda h, p, v: v)}, CASE WHEN greatest(0, mean - {url_filter.Z}*sqrt(mean*(1-mean)/(w + 1))) > {url_filter.MAX_BAD_RATE} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_rate FROM x LEFT JOIN mh USING (host)"""


# ---- op6: the inverse distribution by a running product of Poisson terms
def _hex(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)/{float(1 << 52)!r}"


MIX = f"""WITH RECURSIVE c AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY 1), t AS (SELECT source, (sum(n) OVER ())*1.0e0/((count(*) OVER ())*n) AS mean FROM c),
g AS (SELECT source, parts, mean/parts AS mean FROM (SELECT *, greatest(1, CAST(ceil(mean/{mixing.PART_MEAN}e0) AS BIGINT)) AS parts FROM t)),
k AS (SELECT source, mean, 0 AS k, -mean AS lp, exp(-mean) AS cdf, CAST(ceil(mean + 12*sqrt(mean) + 20) AS INT) AS top FROM g UNION ALL SELECT source, mean, k+1, lp + ln(mean) - ln(CAST(k+1 AS DOUBLE)), cdf + exp(lp + ln(mean) - ln(CAST(k+1 AS DOUBLE))), top FROM k WHERE k < top),
p AS (SELECT d.*, unnest(range(g.parts)) AS part FROM documents d JOIN g ON g.source IS NOT DISTINCT FROM d.source),
u AS (SELECT *, {_hex(f"'count{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || part")} AS u FROM p),
q AS (SELECT u.*, (SELECT count(*) FROM k WHERE k.source IS NOT DISTINCT FROM u.source AND k.cdf <= u.u) AS n FROM u),
e AS (SELECT doc_id, text, lang, source, n_chars, part*{mixing.NUMBERS} + unnest(range(1, n + 1)) AS copy_no FROM q WHERE n > 0)
SELECT *, md5('order{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy_no) AS mix_key FROM e"""


# ---- op7
_DOT = "list_inner_product({0}, {1})"
VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), g AS (SELECT vec_id, label, e, sqrt({_DOT.format('e', 'e')}) AS size FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true) AND {_DOT.format('e', 'e')} > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {_DOT.format('a.e', 'b.e')}/(a.size*b.size) >= {vector_dedup.COSINE}),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), m AS (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c AS component_id, e.vec_id = c AS kept FROM embeddings e LEFT JOIN n USING (vec_id) JOIN m USING (vec_id)"""


# ---- op9
def _canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for _, pattern, to in license_scan.SPELLINGS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    out = f"regexp_replace({out}, {_quoted(license_scan.COPYRIGHT_LINE)}, '', 'g')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_KNOWN = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in license_scan.KNOWN)
LICENSES = f"""WITH known AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({_canonical('t')}) AS digest FROM (VALUES {_KNOWN}) k(license, t)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_canonical('text')}) AS digest FROM documents),
n AS (SELECT r, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, {_quoted(license_scan.NOTICE_LINE)}))) AS line FROM d),
f AS (SELECT r, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices, count(*) AS n FROM n JOIN known k ON k.digest = sha256({_canonical('line')}) GROUP BY r)
SELECT doc_id, d.digest, license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices FROM d LEFT JOIN known USING (digest) LEFT JOIN f USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": NEAR, "op5_url_filter": URLS, "op6_mixing": MIX, "op7_vector_dedup": VECTORS, "op9_license_scan": LICENSES}
