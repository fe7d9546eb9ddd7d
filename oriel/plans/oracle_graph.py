"""The derived entity graph as DuckDB common table expressions, for the oracle SQL."""

LETTERS = "substr('ABCDEFGHIJ', CAST(floor({k} / 10) AS INT) + 1, 1) || substr('ABCDEFGHIJ', CAST({k} % 10 AS INT) + 1, 1)"


def squeeze(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def _name(source: str, key: str, kind: str, value: str) -> str:
    return f"SELECT {key}, '{kind}', {value}, {squeeze(value)}, 'en', '', {'true' if kind == 'canonical' else 'false'} FROM {source}"


N2 = LETTERS.format(k="n_nationkey")
NO_DATE = "CAST(NULL AS DATE)"

GRAPH = f"""
entities(entity_id, entity_type, canonical_name, canonical_name_norm, valid_from, valid_until, prominence, country_code) AS (
  SELECT 'world/0', 'geo.continent', 'World', 'world', {NO_DATE}, {NO_DATE}, CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR)
  UNION ALL SELECT 'region/' || r_regionkey, 'geo.region', r_name, {squeeze('r_name')}, NULL, NULL, NULL, NULL FROM region
  UNION ALL SELECT 'country/' || n_nationkey, 'geo.country', n_name, {squeeze('n_name')}, NULL, NULL, n_nationkey / 25.0::DOUBLE, NULL FROM nation
  UNION ALL SELECT 'org/supp-' || s_suppkey, 'org.company', s_name, {squeeze('s_name')}, NULL, NULL,
    (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), {LETTERS.format(k='s_nationkey')} FROM supplier
  UNION ALL SELECT 'org/cust-' || c_custkey, 'org.company', c_name, {squeeze('c_name')}, CASE WHEN c_custkey % 7 = 0 THEN DATE '1992-01-01' END,
    CASE WHEN c_custkey % 5 = 0 THEN DATE '1998-01-01' END, NULL, {LETTERS.format(k='c_nationkey')} FROM customer
  UNION ALL SELECT 'custom/part-' || p_partkey, 'custom', p_name, {squeeze('p_name')}, NULL, NULL, p_size / 50.0::DOUBLE, NULL FROM part
  UNION ALL SELECT DISTINCT 'groups/' || c_mktsegment, 'geo.organization', c_mktsegment, {squeeze('c_mktsegment')}, {NO_DATE}, {NO_DATE}, CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM customer
),
names(entity_id, name_kind, value, value_norm, lang, script, is_preferred) AS (
  SELECT entity_id, 'canonical', canonical_name, canonical_name_norm, 'en', '', true FROM entities
  UNION ALL {_name('supplier', "'org/supp-' || s_suppkey", 'alias', "replace(s_name, '#', ' ')")}
  UNION ALL {_name('customer', "'org/cust-' || c_custkey", 'alias', "replace(c_name, '#', ' ')")}
  UNION ALL {_name('nation', "'country/' || n_nationkey", 'alias', "replace(n_name, '_', ' ')")}
  UNION ALL {_name('region', "'region/' || r_regionkey", 'exonym', "'The ' || lower(r_name)")}
  UNION ALL {_name('nation', "'country/' || n_nationkey", 'acronym', "'N' || n_nationkey")}
  UNION ALL {_name('supplier', "'org/supp-' || s_suppkey", 'acronym', "'SUPP' || s_suppkey")}
  UNION ALL {_name('part', "'custom/part-' || p_partkey", 'alias', "split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)")} WHERE p_partkey % 3 = 0
),
codes(entity_id, system, value, value_norm) AS (
  SELECT e, s, v, lower(v) FROM (
    SELECT 'country/' || n_nationkey AS e, 'iso2' AS s, {N2} AS v FROM nation
    UNION ALL SELECT 'country/' || n_nationkey, 'iso3', 'N' || {N2} FROM nation
    UNION ALL SELECT 'country/' || n_nationkey, 'iso_numeric', lpad(CAST(n_nationkey AS VARCHAR), 3, '0') FROM nation
    UNION ALL SELECT 'org/supp-' || s_suppkey, 'suppkey', 'S-' || s_suppkey FROM supplier
    UNION ALL SELECT 'org/supp-' || s_suppkey, 'wikidata', 'Q' || (s_suppkey + 1000) FROM supplier
    UNION ALL SELECT 'org/cust-' || c_custkey, 'custkey', 'C-' || c_custkey FROM customer
    UNION ALL SELECT 'custom/part-' || p_partkey, 'partkey', 'P-' || p_partkey FROM part)
),
dated AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS since, CAST(max(o_orderdate) AS DATE) + 1 AS until FROM orders GROUP BY o_custkey),
supplied AS (SELECT l_suppkey, l_partkey, CAST(min(l_shipdate) AS DATE) AS since, CAST(max(l_shipdate) AS DATE) + 1 AS until FROM lineitem GROUP BY l_suppkey, l_partkey),
relations(entity_id, relation_type, target_id, valid_from, valid_until) AS (
  SELECT 'region/' || r_regionkey, 'contained_in', 'world/0', {NO_DATE}, {NO_DATE} FROM region
  UNION ALL SELECT 'country/' || n_nationkey, 'contained_in', 'region/' || n_regionkey, NULL, NULL FROM nation
  UNION ALL SELECT 'org/supp-' || s_suppkey, 'contained_in', 'country/' || s_nationkey, NULL, NULL FROM supplier
  UNION ALL SELECT 'org/cust-' || c_custkey, 'contained_in', 'country/' || c_nationkey, NULL, NULL FROM customer
  UNION ALL SELECT 'org/cust-' || c_custkey, 'member_of', 'groups/' || c_mktsegment, since, until FROM customer JOIN dated ON c_custkey = o_custkey
  UNION ALL SELECT 'org/cust-' || c_custkey, 'subsidiary_of', 'org/supp-' || CAST(floor(c_custkey / 10) AS BIGINT), NULL, NULL FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT 'org/supp-' || l_suppkey, 'supplies', 'custom/part-' || l_partkey, since, until FROM supplied
),
asked(qid, text) AS (
  SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN '  ' || replace(c_name, '#', '  ') || ' '
    WHEN 3 THEN 'C-' || c_custkey WHEN 4 THEN substr(c_name, 1, 2) || substr(c_name, 4) WHEN 5 THEN 'unknown'
    WHEN 6 THEN 'S-' || CAST(floor(c_custkey / 8) AS BIGINT) ELSE 'Supplier 00000' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0') END FROM customer
)
"""


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: a row of bits, one step a character of ``b``; ``a`` has 60 characters at most."""
    full = f"((1::BIGINT << length({a})) - 1)"
    mask = f"coalesce(list_sum(list_transform(range(length({a})), lambda i_: CASE WHEN {a}[i_ + 1] = c_ THEN 1::BIGINT << i_ ELSE 0 END))::BIGINT, 0)"
    masks = f"list_transform(string_split({b}, ''), lambda c_: {mask})"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda s_, m_: ((s_ + (s_ & m_)) | (s_ - (s_ & m_))) & {full})))"


def indel(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE 2 * {lcs(a, b)} / (length({a}) + length({b})) END)::DOUBLE"


def token_set(source: str, a: str, b: str, *keep: str) -> str:
    """A query of ``source`` with its ``keep`` columns and ``token_set``."""
    k = ", ".join(keep)
    return f"""SELECT {k}, CASE WHEN len(x_) = 0 OR len(y_) = 0 THEN 0 WHEN base_ <> '' AND (left_ = base_ OR right_ = base_) THEN 1
      WHEN base_ = '' THEN {indel('left_', 'right_')} ELSE greatest({indel('left_', 'right_')}, {indel('base_', 'left_')}, {indel('base_', 'right_')}) END AS token_set FROM (
      SELECT *, array_to_string(w_, ' ') AS base_, array_to_string(list_concat(w_, u_), ' ') AS left_, array_to_string(list_concat(w_, v_), ' ') AS right_ FROM (
      SELECT *, list_sort(list_filter(x_, lambda e_: list_contains(y_, e_))) AS w_, list_sort(list_filter(x_, lambda e_: NOT list_contains(y_, e_))) AS u_, list_sort(list_filter(y_, lambda e_: NOT list_contains(x_, e_))) AS v_ FROM (
      SELECT *, list_distinct(list_filter(string_split({a}, ' '), lambda e_: e_ <> '')) AS x_, list_distinct(list_filter(string_split({b}, ' '), lambda e_: e_ <> '')) AS y_ FROM {source})))"""


def partial(short: str, long: str) -> str:
    """Best ratio of ``short`` with a window of ``long``."""
    window = f"substr({long}, greatest(w_, 0) + 1, w_ + length({short}) - greatest(w_, 0))"
    ratio = indel(short, "x_")
    return f"(CASE WHEN length({short}) = 0 THEN (CASE WHEN length({long}) = 0 THEN 1 ELSE 0 END)::DOUBLE ELSE list_max(list_transform(range(1 - length({short}), length({long})), lambda w_: list_transform([{window}], lambda x_: {ratio})[1])) END)"


def sql(body: str, *more: str) -> str:
    """A query over the graph; ``more`` are further table expressions."""
    return "WITH RECURSIVE " + ",\n".join([GRAPH.strip(), *more]) + "\n" + body
