"""DuckDB SQL for the library's queries."""

_SERIAL = "(date_diff('day', DATE '1899-12-31', CAST(o_orderdate AS DATE)) + 1)"
_DAY = "CAST(o_orderdate AS DATE)"

ORACLE_SQL = {
    "sumifs_by_segment": """
SELECT c_mktsegment AS segment, round(sum(CASE WHEN o_totalprice > 0 THEN o_totalprice ELSE 0 END), 2) AS total,
       CAST(count(*) FILTER (o_totalprice > 100000) AS DOUBLE) AS large
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "conditional_aggregates": """
SELECT l_returnflag, round(coalesce(sum(l_extendedprice) FILTER (l_quantity >= 25 AND l_linestatus = 'O'), 0), 2) AS sumifs,
       round(avg(l_extendedprice) FILTER (l_quantity < 10), 4) AS averageifs, round(avg(l_quantity) FILTER (l_quantity <> 7), 6) AS averageif,
       CAST(count(*) FILTER (l_quantity > 10 AND lower(l_linestatus) = 'f') AS DOUBLE) AS countifs,
       CAST(count(*) FILTER (length(l_linestatus) = 1) AS DOUBLE) AS countif,
       coalesce(max(l_extendedprice) FILTER (l_quantity = 1), 0) AS maxifs, coalesce(min(l_extendedprice) FILTER (l_quantity > 49), 0) AS minifs
FROM lineitem GROUP BY 1""",
    "criteria_wildcards": """
SELECT p_brand, CAST(count(*) FILTER (p_type ILIKE '%a%') AS DOUBLE) AS with_a, CAST(count(*) FILTER (NOT p_type ILIKE '%a%') AS DOUBLE) AS without_a,
       round(coalesce(sum(p_retailprice) FILTER (p_name ILIKE 'p%'), 0), 2) AS total
FROM part GROUP BY 1""",
    "plain_aggregates": """
SELECT l_returnflag, round(sum(q), 4) AS "sum", round(avg(q), 8) AS average, round(min(q), 4) AS "min", round(max(q), 4) AS "max", CAST(count(q) AS DOUBLE) AS "count",
       round(sum(q * q), 2) AS sumsq, round(stddev_samp(q), 6) AS stdev_s, round(stddev_pop(q), 6) AS stdev_p, round(var_samp(q), 5) AS var_s, round(var_pop(q), 5) AS var_p,
       round(median(q), 6) AS median, round(var_pop(q) * count(q), 2) AS devsq, round(exp(avg(ln(q))), 6) AS geomean, round(count(q) / sum(1 / q), 6) AS harmean,
       CAST(count(q) AS DOUBLE) AS counta, CAST(count(*) - count(q) AS DOUBLE) AS countblank, round(avg(q), 8) AS averagea, round(max(q), 4) AS maxa, round(min(q), 4) AS mina
FROM (SELECT l_returnflag, l_quantity AS q FROM lineitem) GROUP BY 1""",
    "numbered_aggregates": """
SELECT l_linestatus, round(avg(q), 4) AS s1, CAST(count(q) AS DOUBLE) AS s2, CAST(count(q) AS DOUBLE) AS s3, max(q) AS s4, min(q) AS s5, round(stddev_samp(q), 4) AS s7,
       round(stddev_pop(q), 4) AS s8, round(sum(q), 4) AS s9, round(var_samp(q), 4) AS s110, round(var_pop(q), 4) AS s111
FROM (SELECT l_linestatus, l_quantity AS q FROM lineitem) GROUP BY 1""",
    "shape_statistics": """
SELECT l_returnflag, round(skewness(l_extendedprice), 5) AS skew, round(kurtosis(l_extendedprice), 5) AS kurt, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1
FROM lineitem GROUP BY 1""",
    "regression": """
SELECT l_returnflag, round(regr_slope(y, x), 3) AS slope, round(regr_intercept(y, x), 3) AS intercept, round(regr_r2(y, x), 3) AS rsq, round(corr(y, x), 3) + 0.0 AS correl,
       round(covar_pop(y, x), 3) AS covariance_p, round(covar_samp(y, x), 3) AS covariance_s, round(sum(y * y - x * x), 3) AS sumx2my2, round(sum(y * y + x * x), 3) AS sumx2py2,
       round(sum((y - x) * (y - x)), 3) AS sumxmy2, round(sum(x * y), 3) AS sumproduct, round(regr_intercept(y, x) + 30 * regr_slope(y, x), 3) AS forecast
FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x FROM lineitem) GROUP BY 1""",
    "vlookup_exact": """
SELECT l_orderkey, l_linenumber, p_brand AS brand, p_size AS size, CASE WHEN p_partkey IS NULL THEN '#N/A' END AS error
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "xlookup_last": """
SELECT c_custkey, price, CASE WHEN o_custkey IS NULL THEN '#N/A' END AS error
FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "lookup_approximate": """
WITH bands AS (SELECT i * 1000.0 - 500 AS start, 'band ' || i AS band FROM range(0, 11) t(i))
SELECT c_custkey, (SELECT arg_max(band, start) FROM bands WHERE start <= c_acctbal) AS band,
       CASE WHEN c_acctbal < -500 THEN '#N/A' END AS error
FROM customer""",
    "match_next": """
SELECT c_custkey, o_totalprice AS price FROM customer ASOF LEFT JOIN (SELECT DISTINCT o_totalprice FROM orders) ON c_acctbal <= o_totalprice""",
    "xlookup_wildcard": """
SELECT i AS id, (SELECT min(s_suppkey) FROM supplier WHERE s_name LIKE '%' || i || '_') AS supplier,
       CASE WHEN (SELECT min(s_suppkey) FROM supplier WHERE s_name LIKE '%' || i || '_') IS NULL THEN '#N/A' END AS error
FROM range(1, 6) t(i)""",
    "index_match": """
SELECT CAST(i AS INTEGER) AS k, n_name AS name, CASE WHEN n_name IS NULL THEN '#REF!' END AS error
FROM range(0, 30) t(i) LEFT JOIN nation ON n_nationkey + 1 = CASE WHEN i = 0 THEN 1 ELSE i END""",
    "countif_exists": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer",
    "sumifs_per_row": """
SELECT c_custkey, round(coalesce(total, 0), 2) AS total, coalesce(n, 0) AS orders
FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "rank_table": """
SELECT c_custkey, CAST(rank() OVER (ORDER BY c_acctbal DESC) AS DOUBLE) AS rank,
       rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS rank_avg
FROM customer""",
    "rank_in_group": """
SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rank FROM part""",
    "large_small": """
SELECT (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 1 OFFSET 9) AS value, 'large' AS which
UNION ALL SELECT (SELECT o_totalprice FROM orders ORDER BY o_totalprice LIMIT 1 OFFSET 9), 'small'""",
    "percentile_exclusive": """
WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders),
     p AS (SELECT DISTINCT 0.3::DOUBLE * (n + 1) - 1 AS spot FROM s)
SELECT round(a.v + (b.v - a.v) * (spot - floor(spot)), 4) AS value FROM p JOIN s a ON a.i = floor(spot) JOIN s b ON b.i = ceil(spot)""",
    "trimmed_mean": """
WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders)
SELECT round(avg(v), 4) AS value FROM s WHERE i > floor(n * 0.2 / 2) AND i <= n - floor(n * 0.2 / 2)""",
    "mode_first_seen": "SELECT CAST(p_size AS DOUBLE) AS value FROM part GROUP BY p_size HAVING count(*) > 1 ORDER BY count(*) DESC, min(p_partkey) LIMIT 1",
    "frequency_bins": """
SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n
FROM range(1, 6) t(i) LEFT JOIN (SELECT least(greatest(CAST(ceil(l_quantity / 10) AS INTEGER), 1), 5) AS b, count(*) AS n FROM lineitem GROUP BY 1) ON b = i""",
    "average_deviation": "SELECT round(avg(abs(l_quantity - (SELECT avg(l_quantity) FROM lineitem))), 6) AS value FROM lineitem",
    "standardized": """
SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER w) / stddev_samp(p_retailprice) OVER w, 6) AS z FROM part WINDOW w AS (PARTITION BY p_brand)""",
    "operators_arithmetic": """
SELECT l_orderkey, l_linenumber, round(l_quantity * 2 + -l_tax, 6) AS "sum", round(l_extendedprice - l_quantity, 4) AS difference, round(pow(l_quantity, 2), 4) AS square,
       CASE WHEN l_tax <> 0 THEN round(l_extendedprice / l_tax, 4) END AS ratio, CASE WHEN l_tax = 0 THEN '#DIV/0!' END AS error, l_quantity >= 25 AS many,
       l_returnflag || l_linestatus AS flags, CAST(l_quantity AS BIGINT) || 'x' AS label
FROM lineitem""",
    "rounding": """
SELECT c_custkey, round(floor(x * 10 + 0.5) / 10, 4) + 0.0 AS round, round(sign(x) * ceil(abs(x)), 4) AS roundup, round(sign(x) * floor(abs(x)), 4) + 0.0 AS rounddown, round(sign(x) * floor(abs(x) * 10) / 10, 4) + 0.0 AS trunc,
       floor(x) AS "int", ceil(x / 5) * 5 + 0.0 AS ceiling, floor(x / 5) * 5 + 0.0 AS floor, sign(x) * ceil(abs(x) / 2) * 2 AS even, CASE WHEN x = 0 THEN 1 ELSE sign(x) * (ceil((abs(x) - 1) / 2) * 2 + 1) END AS odd,
       floor(abs(x) / 25 + 0.5) * 25 AS mround, round(x % 7, 4) + 0.0 AS mod, sign(x) * floor(abs(x / 7)) + 0.0 AS quotient, CAST(sign(x) AS DOUBLE) AS sign, round(abs(x), 4) AS abs
FROM (SELECT c_custkey, c_acctbal AS x FROM customer)""",
    "elementary": """
SELECT l_orderkey, l_linenumber, round(sin(x), 8) AS sin, round(cos(x), 8) AS cos, round(tan(x), 8) AS tan, round(asin(x), 8) AS asin, round(acos(x), 8) AS acos, round(atan(x), 8) AS atan,
       round(sinh(x), 8) AS sinh, round(cosh(x), 8) AS cosh, round(tanh(x), 8) AS tanh, round(exp(x), 8) AS exp, round(sqrt(x), 8) AS sqrt, round(sqrt(x * pi()), 8) AS sqrtpi, round(radians(x), 8) AS radians,
       round(degrees(x), 8) AS degrees, round(1 / cos(x), 8) AS sec, round(CASE WHEN x = 0 THEN pi() / 2 ELSE atan(1 / x) END, 8) AS acot, round(ln(q), 8) AS ln, round(log10(q), 8) AS log10, round(ln(q) / ln(2), 8) AS log2,
       round(atan2(x, q), 8) AS atan2, round(1 / tan(q), 8) AS cot, round(1 / sin(q), 8) AS csc
FROM (SELECT l_orderkey, l_linenumber, l_discount AS x, l_quantity AS q FROM lineitem)""",
    "combinatorics": """
SELECT p_partkey, CAST(factorial(k) AS DOUBLE) AS fact, CAST(list_extract([1, 1, 2, 3, 8, 15, 48], k + 1) AS DOUBLE) AS factdouble,
       CASE WHEN k <= n THEN round(list_reduce(list_prepend(1::DOUBLE, list_transform(range(1, k + 1), lambda i: (n - k + i)::DOUBLE / i)), lambda a, b: a * b)) END AS combin,
       round(CASE WHEN k = 0 THEN 0 ELSE k * (k + 1) * (k + 2) / 6 END, 0) AS combina,
       list_reduce(list_prepend(1::DOUBLE, list_transform(range(1, k + 1), lambda i: ceil(n / 7) * 7 - k + i)), lambda a, b: a * b) AS permut,
       CAST(gcd(n, 36) AS DOUBLE) AS gcd, CAST(lcm(n, 12) AS DOUBLE) AS lcm, lpad(bin(n), CAST(greatest(6, length(bin(n))) AS INTEGER), '0') AS base,
       ['', 'X', 'XX', 'XXX', 'XL', 'L'][n // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman,
       CAST(n AS DOUBLE) AS arabic, CAST(n AS DOUBLE) AS decimal, CAST(factorial(k + 3) AS DOUBLE) / (factorial(k) * 2) AS multinomial, n % 2 = 0 AS iseven, n % 2 = 1 AS isodd,
       CASE WHEN n > 26 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || '1' AS letters
FROM (SELECT p_partkey, p_size AS n, p_size % 7 AS k FROM part)""",
    "text_functions": """
SELECT p_partkey, left(s, 3) AS "left", right(s, 4) AS "right", substr(s, 2, 3) AS mid, CAST(length(s) AS DOUBLE) AS len, upper(s) AS upper, lower(p_type) AS lower, trim(s) AS trim, '<>' || substr(s, 3) AS replace,
       replace(s, 'a', '@') AS substitute, CASE WHEN len(string_split(s, 'a')) > 2 THEN regexp_replace(s, '^([^a]*a[^a]*)a', '\\1@') ELSE s END AS second, repeat(left(s, 1), 3) AS rept, s = lower(s) AS exact,
       CAST(ascii(s) AS DOUBLE) AS code, s || '-' || p_size AS concat, s || ',' || p_type AS "join", CAST(instr(s, 'a') AS DOUBLE) AS find,
       CAST(CASE WHEN regexp_matches(lower(s), 'a.') THEN length(regexp_extract(lower(s), '^(.*?)a.', 1)) + 1 ELSE 0 END AS DOUBLE) AS search,
       list_aggregate(list_transform(string_split(s, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), 'string_agg', ' ') AS proper
FROM (SELECT *, p_name AS s FROM part)""",
    "text_numbers": """
SELECT c_custkey, CASE WHEN x < 0 THEN '($' || format('{:,.2f}', -x) || ')' ELSE '$' || format('{:,.2f}', x) END AS dollar,
       CASE WHEN x < 0 THEN '-' ELSE '' END || format('{:,.1f}', abs(x)) AS fixed, CASE WHEN x < 0 THEN '-' ELSE '' END || format('{:.2f}', abs(x)) AS plain,
       regexp_replace(CAST(x AS VARCHAR), '\\.0$', '') AS shown, x AS value, x AS numbervalue, split_part(c_name, '#', 1) AS before, split_part(c_name, '#', 2) AS after
FROM (SELECT *, c_acctbal AS x FROM customer)""",
    "text_urls": "SELECT page_id, replace(replace(replace(replace(url_encode(url), '%21', '!'), '%28', '('), '%29', ')'), '%27', '''') AS encoded, CAST(length(html) + length(regexp_replace(html, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS DOUBLE) AS length FROM pages",
    "conditions": """
SELECT l_orderkey, l_linenumber, CASE WHEN q > 25 THEN 'many' ELSE 'few' END AS "if", q > 10 AND t < 0.05 AS "and", q > 45 OR t = 0 AS "or", t = 0 AS "not", (q > 10) <> (t < 0.05) AS xor,
       CASE WHEN q < 10 THEN 'low' WHEN q < 30 THEN 'middle' ELSE 'high' END AS ifs, CASE l_returnflag WHEN 'A' THEN 'first' WHEN 'N' THEN 'second' ELSE 'other' END AS switch,
       CASE WHEN t = 0 THEN -1 ELSE round(q / t, 4) END AS iferror, l_linenumber * 10.0::DOUBLE AS choose
FROM (SELECT *, l_quantity AS q, l_tax AS t FROM lineitem)""",
    "logical_aggregates": """
SELECT l_orderkey, bool_and(l_quantity > 5) AS "all", bool_or(l_quantity > 45) AS "any", count(*) FILTER (l_quantity > 25) % 2 = 1 AS odd FROM lineitem GROUP BY 1""",
    "information": """
SELECT l_orderkey, l_linenumber, l_tax = 0 AS iserror, false AS isna, l_tax = 0 AS iserr, CASE WHEN l_tax = 0 THEN 16.0::DOUBLE ELSE 1 END AS type, CASE WHEN l_tax = 0 THEN 2.0::DOUBLE ELSE 0 END AS kind,
       true AS isnumber, true AS istext, round(l_tax, 4) AS n
FROM lineitem""",
    "dates": f"""
SELECT o_orderkey, CAST({_SERIAL} AS DOUBLE) AS serial, CAST(year({_DAY}) AS DOUBLE) AS year, CAST(month({_DAY}) AS DOUBLE) AS month, CAST(day({_DAY}) AS DOUBLE) AS day,
       CAST(dayofweek({_DAY}) + 1 AS DOUBLE) AS weekday, CAST(isodow({_DAY}) AS DOUBLE) AS weekday2, floor((dayofyear({_DAY}) - 1 + dayofweek(date_trunc('year', {_DAY}))) / 7) + 1 AS weeknum,
       CAST(weekofyear({_DAY}) AS DOUBLE) AS isoweek, CAST(date_diff('day', DATE '1899-12-31', CAST({_DAY} + INTERVAL 1 MONTH AS DATE)) + 1 AS DOUBLE) AS edate,
       CAST(date_diff('day', DATE '1899-12-31', last_day({_DAY})) + 1 AS DOUBLE) AS eomonth, CAST({_SERIAL} - day({_DAY}) + 1 AS DOUBLE) AS date, CAST({_SERIAL} - 36526 AS DOUBLE) AS days,
       CAST((year({_DAY}) - 2000) * 360 + (month({_DAY}) - 1) * 30 + day({_DAY}) - 1 AS DOUBLE) AS days360, round(abs({_SERIAL} - 36526) / 365, 6) AS yearfrac,
       CAST((year({_DAY}) - 1982) * 12 + month({_DAY}) - 2 - CASE WHEN day({_DAY}) < 18 THEN 1 ELSE 0 END AS DOUBLE) AS months
FROM orders""",
    "working_days": f"""
SELECT o_orderkey, CAST(len(list_filter(generate_series({_DAY}, {_DAY} + INTERVAL 30 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS DOUBLE) AS networkdays,
       CAST(len(list_filter(generate_series({_DAY}, {_DAY} + INTERVAL 30 DAY, INTERVAL 1 DAY), lambda d: isodow(d) <> 5)) AS DOUBLE) AS friday,
       CAST({_SERIAL} + date_diff('day', {_DAY}, list_filter(generate_series({_DAY} + INTERVAL 1 DAY, {_DAY} + INTERVAL 20 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6)[10]::DATE) AS DOUBLE) AS workday
FROM orders""",
    "clock": """
SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour, CAST(minute(ts) AS DOUBLE) AS minute, CAST(second(ts) AS DOUBLE) AS second, round((hour(ts) * 3600 + minute(ts) * 60) / 86400, 8) AS time FROM events""",
    "annuities": """
WITH t AS (SELECT l_orderkey, l_linenumber, l_discount + 0.01 AS r, l_linenumber + 5 AS n, l_extendedprice AS p FROM lineitem), u AS (SELECT *, pow(1 + r, n) AS g FROM t), v AS (SELECT *, -(r * p * g) / (g - 1) AS m FROM u)
SELECT l_orderkey, l_linenumber, round(m, 4) AS pmt, round(-(p * g + 100 * (g - 1) / r), 4) AS fv, round(-(100 * (g - 1) / r) / g, 4) AS pv, round(CASE WHEN -0.5 * p / (p * r - 0.5 * p) > 0 THEN ln(-0.5 * p / (p * r - 0.5 * p)) / ln(1 + r) END, 4) AS nper,
       round((p * (1 + r) + m) * r, 4) AS ipmt, round(m - (p * (1 + r) + m) * r, 4) AS ppmt, round(pow(1 + r / 4, 4) - 1, 4) AS effect, round(4 * (pow(r + 1, 0.25) - 1), 4) AS nominal, round(p / (1 + r) + p / pow(1 + r, 2) + 5 / pow(1 + r, 3), 4) AS npv
FROM v""",
    "depreciation": """
SELECT p_partkey, round((c - c / 10) / 10, 4) AS sln, round((c - c / 10) * 8 * 2 / 110, 4) AS syd, round(c * 0.2, 4) AS ddb, round(c * 0.8 * 0.8 * 0.2, 4) AS ddb3, round(c * 0.206, 4) AS db,
       round(floor(c) + (c - floor(c)) * 10 / 8, 4) AS dollarde, round(floor(c) + (c - floor(c)) * 8 / 10, 4) AS dollarfr
FROM (SELECT p_partkey, p_retailprice AS c FROM part)""",
    "cumulative_loans": """
WITH t AS (SELECT l_orderkey, l_linenumber, l_discount + 0.01 AS r, l_linenumber + 5 AS n, l_extendedprice AS p FROM lineitem), v AS (SELECT *, -(r * p * pow(1 + r, n)) / (pow(1 + r, n) - 1) AS m FROM t)
SELECT l_orderkey, l_linenumber, round(p * r + (p * (1 + r) + m) * r + (p * (1 + r) * (1 + r) + m * (2 + r)) * r, 4) AS interest,
       round(3 * m - (p * r + (p * (1 + r) + m) * r + (p * (1 + r) * (1 + r) + m * (2 + r)) * r), 4) AS principal
FROM v""",
    "distributions": """
SELECT l_orderkey, l_linenumber, round(exp(-0.5 * x * x) / sqrt(2 * pi()), 8) AS density, round(exp(-0.5 * pow((x - 0.5) / 2, 2)) / (2 * sqrt(2 * pi())), 8) AS norm, round(exp(-3) * pow(3, k) / factorial(k), 8) AS poisson,
       round(factorial(10)::DOUBLE / factorial(k) / factorial(10 - k) * pow(0.3, k) * pow(0.7, 10 - k), 8) AS binom, round(1 - exp(-pow(k / 3, 2)), 8) AS weibull, round(1 - exp(-0.5 * k), 8) AS expon, round(0.5 * ln((1 + l_discount) / (1 - l_discount)), 8) AS fisher,
       round((exp(2 * x) - 1) / (exp(2 * x) + 1), 8) AS fisherinv, round(exp(-0.5 * pow((ln(k) - 1) / 2, 2)) / (k * 2 * sqrt(2 * pi())), 8) AS lognorm, round((k - 3) / 2, 8) AS standard
FROM (SELECT *, l_discount * 20 - 1 AS x, l_linenumber AS k FROM lineitem)""",
    "normal_approximations": """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount * 20 - 1 AS x FROM lineitem),
     p AS (SELECT *, 0.5 + list_sum(list_transform(range(0, 30), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow(x, 2 * k + 1) / (gamma(k + 1) * pow(2, k) * (2 * k + 1)))) / sqrt(2 * pi()) AS q FROM x)
SELECT l_orderkey, l_linenumber, round(q, 5) + 0.0 AS dist, round(x, 2) + 0.0 AS back, round(10 + 2 * x, 2) AS scaled, round(1.959964 * l_quantity / 2, 1) AS confidence FROM p""",
    "arrays": """
WITH t AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(a, 'DESC'), ', ') AS sorted, (SELECT string_agg(v, ', ' ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(a) AS v, unnest(range(len(a))) AS i) GROUP BY v)) AS "unique",
       CASE WHEN len(list_filter(a, lambda x: x > 25)) = 0 THEN '0' ELSE array_to_string(list_filter(a, lambda x: x > 25), ', ') END AS large, round(list_aggregate(a, 'median'), 4) AS median, CAST(list_max(a) AS DOUBLE) AS largest,
       round(CAST(list_sum(list_transform(a, lambda x: x * x)) AS DOUBLE), 2) AS squares, 1.0::DOUBLE AS "at"
FROM t""",
    "split_text": "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last FROM part",
    "grid_recalculation": """
SELECT CAST(o_orderkey + 1 AS INTEGER) AS row, 2 AS col, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders), 10) AS n FROM orders
UNION ALL SELECT 1, 3, 1.0""",
    "running_ranges": """
WITH o AS (SELECT CAST(o_orderkey + 1 AS INTEGER) AS row, o_totalprice AS p FROM orders)
SELECT row, 2 AS col, round(sum(p) OVER (ORDER BY row), 4) AS n FROM o
UNION ALL SELECT row, 3, n FROM (SELECT row, round(avg(p) OVER (ORDER BY row ROWS 2 PRECEDING), 4) AS n FROM o) WHERE row >= 3
UNION ALL SELECT row, 4, n FROM (SELECT row, min(p) OVER (ORDER BY row ROWS 99 PRECEDING) AS n FROM o) WHERE row >= 100
UNION ALL SELECT row, 5, max(p) OVER (ORDER BY row ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) FROM o""",
    "running_balance": """
SELECT CAST(a.o_orderkey + 1 AS INTEGER) AS row, round(sum(b.o_totalprice * pow(0.7, a.o_orderkey - b.o_orderkey)), 2) AS n
FROM orders a JOIN orders b ON b.o_orderkey BETWEEN a.o_orderkey - 150 AND a.o_orderkey GROUP BY 1""",
    "merged_areas": """
WITH c AS (SELECT l_orderkey + 1 AS row, l_linenumber AS col, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
     m AS (SELECT o_orderkey + 1 AS r1, o_orderkey + 1 + o_orderkey % 7 * 10 AS r2 FROM orders WHERE o_orderkey % 100 = 7),
     p AS (SELECT row, col, coalesce(r1, row) AS ar, CASE WHEN r1 IS NULL THEN col ELSE 1 END AS ac FROM c LEFT JOIN m ON row BETWEEN r1 AND r2 AND col BETWEEN 1 AND 3)
SELECT CAST(p.row AS INTEGER) AS row, CAST(p.col AS INTEGER) AS col, a.q AS n FROM p LEFT JOIN c a ON a.row = p.ar AND a.col = p.ac""",
    "workbook_round_trip": """
SELECT 'Nations' AS sheet, CAST(n_nationkey + 1 AS INTEGER) AS row, 1 AS col, CAST(NULL AS DOUBLE) AS n, n_name AS s FROM nation
UNION ALL SELECT 'Nations', CAST(n_nationkey + 1 AS INTEGER), 2, n_regionkey, NULL FROM nation
UNION ALL SELECT 'Customers', CAST(c_custkey + 1 AS INTEGER), 1, NULL, c_name FROM customer
UNION ALL SELECT 'Customers', CAST(c_custkey + 1 AS INTEGER), 2, c_acctbal, NULL FROM customer
UNION ALL SELECT 'Customers', CAST(c_custkey + 1 AS INTEGER), 3, NULL, c_mktsegment FROM customer""",
    "shared_string_numbers": """
SELECT text, row_number() OVER (ORDER BY first, text) - 1 AS idx FROM (SELECT p_name AS text, min(p_partkey) AS first FROM part WHERE p_name IS NOT NULL GROUP BY 1)""",
    "format_rules": """
WITH c AS (SELECT CAST(c_custkey + 1 AS INTEGER) AS row, c_acctbal AS v, c_nationkey AS k, c_mktsegment AS s FROM customer),
     f AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS m, min(k) AS klo, max(k) AS khi FROM c),
     o AS (SELECT v, row_number() OVER (ORDER BY v DESC) - 1 AS d, row_number() OVER (ORDER BY v) - 1 AS a FROM c),
     e AS (SELECT (SELECT v FROM o WHERE d = 24) AS top, (SELECT v FROM o, f WHERE a = greatest(ceil(n / 10.0), 1) - 1) AS bottom, (SELECT v FROM o, f WHERE a = ceil((n - 1) * 10.0 / 100)) AS p10),
     x AS (SELECT c.*, f.*, e.*, (v - lo) / (hi - lo) AS t FROM c, f, e)
SELECT row, 1 AS col, 'a' AS rule, CAST(NULL AS VARCHAR) AS color, CAST(NULL AS DOUBLE) AS bar, CAST(NULL AS INTEGER) AS icon FROM x WHERE v < 0
UNION ALL SELECT row, 1, 'b', NULL, NULL, NULL FROM x WHERE v BETWEEN 1000 AND 2000
UNION ALL SELECT row, 1, 'c', NULL, NULL, NULL FROM x WHERE v >= top AND v >= 0
UNION ALL SELECT row, 1, 'd', NULL, NULL, NULL FROM x WHERE v <= bottom AND v >= 0
UNION ALL SELECT row, 1, 'e', NULL, NULL, NULL FROM x WHERE v > m AND v >= 0
UNION ALL SELECT row, 3, 'f', NULL, NULL, NULL FROM x WHERE contains(s, 'BUILD')
UNION ALL SELECT row, 3, 'g', NULL, NULL, NULL FROM x WHERE starts_with(s, 'A')
UNION ALL SELECT row, 1, 'h', lpad(upper(to_hex(CAST(floor(255 - t * 255 + 0.5) AS BIGINT))), 2, '0') || lpad(upper(to_hex(CAST(floor(t * 255 + 0.5) AS BIGINT))), 2, '0') || '00', NULL, NULL FROM x WHERE v >= 0
UNION ALL SELECT row, 1, 'i', NULL, round(least(greatest((v - p10) / (hi - p10), 0), 1) * 100, 6), NULL FROM x WHERE v >= 0
UNION ALL SELECT row, 2, 'j', NULL, NULL, CASE WHEN k >= klo + (khi - klo) * 0.67 THEN 2 WHEN k >= klo + (khi - klo) * 0.33 THEN 1 ELSE 0 END FROM x""",
    "rates": """
WITH RECURSIVE n AS (SELECT DISTINCT p_size + 2 AS n FROM part),
r AS (SELECT n, 1e-9::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM n UNION ALL SELECT n, CASE WHEN f < 0 THEN mid ELSE lo END, CASE WHEN f < 0 THEN hi ELSE mid END, i + 1
      FROM (SELECT *, pow(1 + mid, n) - 1.2::DOUBLE / n * (pow(1 + mid, n) - 1) / mid AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM r)) WHERE i < 60),
v AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i UNION ALL SELECT CASE WHEN f > 0 THEN mid ELSE lo END, CASE WHEN f > 0 THEN hi ELSE mid END, i + 1
      FROM (SELECT *, list_sum(list_transform(range(1, 6), lambda k: 0.3 / pow(1 + mid, k))) - 1 AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM v)) WHERE i < 60)
SELECT p_partkey, round(r.lo, 6) AS rate, round(v.lo, 8) AS irr, round(pow(list_sum(list_transform(range(0, 5), lambda k: 0.3 * pow(1.06, k))), 0.2) - 1, 8) AS mirr
FROM part JOIN r ON r.n = p_size + 2 AND r.i = 60, v WHERE v.i = 60""",
    "formula_references": """
WITH c AS (SELECT CAST(c_custkey + 1 AS INTEGER) AS row FROM customer)
SELECT 'Customers' AS sheet, row, 4 AS col, 'Customers' AS src_sheet, row AS r1, 2 AS c1, row AS r2, 2 AS c2 FROM c
UNION ALL SELECT 'Customers', row, 4, 'Na''tions', 1, 1, 25, 3 FROM c
UNION ALL SELECT 'Customers', row, 4, 'Customers', 1, 3, row, 3 FROM c""",
    "dependents": """
WITH RECURSIVE t AS (SELECT CAST(o_orderkey + 1 AS INTEGER) AS row FROM orders), r AS (SELECT 3 AS row UNION ALL SELECT t.row FROM t JOIN r ON t.row // 2 = r.row WHERE t.row > 1)
SELECT row, 1 AS col FROM r WHERE row <> 3""",
    "chart_axes": """
WITH s AS (SELECT c_mktsegment, c_nationkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1, 2),
     p AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY k) - 1 AS i, k, v FROM s QUALIFY i < 12),
     e AS (SELECT c_mktsegment, least(min(v), 0) AS low, greatest(max(v), 0) AS high FROM p GROUP BY 1),
     t AS (SELECT c_mktsegment, i, low + (high - low) * i / 4 AS v FROM e, range(0, 5) r(i))
SELECT c_mktsegment, 'point' AS kind, CAST(i AS INTEGER) AS i, CASE WHEN i < 10 THEN k::VARCHAR ELSE (i + 1)::VARCHAR END AS text, round(v, 2) AS value FROM p
UNION ALL SELECT c_mktsegment, 'tick', CAST(i AS INTEGER), CASE WHEN abs(v) >= 1e6 THEN 'M' WHEN abs(v) >= 1e3 THEN 'K' ELSE '' END, round(v, 2) FROM t""",
    "text_rules": """
WITH t AS (SELECT *, p_size / 50.0 - 0.5 AS t FROM part),
     c AS (SELECT *, list_transform([64, 128, 192], lambda x: CAST(floor(CASE WHEN t < 0 THEN x * (1 + t) ELSE x + (255 - x) * t END + 0.5) AS BIGINT)) AS c FROM t)
SELECT p_partkey, coalesce(contains(p_name, 'er'), false) AS has, NOT contains(coalesce(p_name, ''), 'er') AS lacks, coalesce(starts_with(p_name, 'b'), false) AS begins, coalesce(suffix(p_name, 'n'), false) AS ends,
       lpad(upper(to_hex(c[1])), 2, '0') || lpad(upper(to_hex(c[2])), 2, '0') || lpad(upper(to_hex(c[3])), 2, '0') AS tinted FROM c""",
    "custom_functions": """
SELECT p_partkey, floor(p_retailprice * 1.25 * 10 + 0.5) / 10 AS marked, round(avg(p_retailprice * 2) OVER (PARTITION BY p_brand), 4) AS mean FROM part""",
    "grid_edits": """
WITH a AS (SELECT n_nationkey + 1 AS row, CASE WHEN n_nationkey < 3 THEN (n_nationkey + 1) * 10 ELSE n_regionkey END::DOUBLE AS n FROM nation)
SELECT row, 1 AS col, n FROM a UNION ALL SELECT row, 3, n * 2 FROM a""",
    "format_top": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS i, avg(p_retailprice) OVER (PARTITION BY p_brand) AS m FROM part), e AS (SELECT p_brand, min(p_retailprice) AS edge FROM r WHERE i <= 5 GROUP BY 1)
SELECT p_partkey, p_retailprice >= edge AS top, p_retailprice > m AS above, p_retailprice BETWEEN 1000 AND 1200 AS between FROM r JOIN e USING (p_brand)""",
    "format_scales": """
WITH t AS (SELECT c_custkey, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS s, c_acctbal AS v, min(c_acctbal) OVER () AS a, max(c_acctbal) OVER () AS b FROM customer)
SELECT c_custkey, lpad(upper(to_hex(CAST(floor(255 + s * -255 + 0.5) AS BIGINT))), 2, '0') || lpad(upper(to_hex(CAST(floor(s * 255 + 0.5) AS BIGINT))), 2, '0') || '00' AS color, round(s * 100, 6) AS bar,
       CASE WHEN v >= a + (b - a) * 0.67 THEN 2 WHEN v >= a + (b - a) * 0.33 THEN 1 ELSE 0 END AS icon
FROM t""",
    "chart_figures": """
WITH t AS (SELECT c_mktsegment, c_nationkey, sum(c_acctbal) AS value FROM customer GROUP BY ALL)
SELECT c_mktsegment, c_nationkey, round(abs(value) / sum(abs(value)) OVER w, 6) AS share, round(least(min(value) OVER w, 0), 6) AS low, round(greatest(max(value) OVER w, 0), 6) AS high FROM t WINDOW w AS (PARTITION BY c_mktsegment)""",
    "further_rounding": """
SELECT c_custkey, round(x * x, 4) AS power, ceil(x / 5) * 5 + 0.0 AS ceiling, CASE WHEN x < 0 THEN floor(x / 5) ELSE ceil(x / 5) END * 5 + 0.0 AS ceiling_math, floor(abs(x) / 5) * 5 AS floor, floor(x / 5) * 5 + 0.0 AS floor_precise,
       round(x / 1000 + 0.5 * pow(x / 1000, 3) + 0.25 * pow(x / 1000, 5), 4) + 0.0 AS seriessum, round(pi() * x, 4) + 0.0 AS circle, round(x * 6, 4) + 0.0 AS product, round((x + 10) / 2, 4) + 0.0 AS average
FROM (SELECT c_custkey, c_acctbal AS x FROM customer)""",
    "random_numbers": 'SELECT p_partkey, true AS rand, true AS "between", true AS now, true AS today FROM part',
    "constants": """
SELECT n_nationkey, true AS "true", false AS "false", CAST(n_regionkey AS DOUBLE) AS ifna, CAST(n_regionkey AS DOUBLE) AS kept, 1.0::DOUBLE AS "row", 1.0::DOUBLE AS "rows", 1.0::DOUBLE AS "column", 1.0::DOUBLE AS "columns", 2.0::DOUBLE AS areas,
       1.0::DOUBLE AS sheet, 1.0::DOUBLE AS sheets, '' AS cell, '16.0' AS info, n_name AS t, '' AS t_of_number, false AS isref, false AS isformula, n_name = 'CHINA' AS isblank, true AS islogical, true AS isnontext, false AS text_isnontext,
       '#N/A' AS na, '#N/A' AS formulatext, '#VALUE!' AS row_of
FROM nation""",
    "text_codes": """
SELECT p_partkey, p_name || '-' || p_size AS concatenate, CAST(p_size AS VARCHAR) AS text, chr(CAST(p_size % 26 + 65 AS INTEGER)) AS char, p_name AS clean, CAST(ascii(p_name) AS DOUBLE) AS unicode, chr(CAST(p_size + 944 AS INTEGER)) AS unichar
FROM part""",
    "text_dates": f"""
SELECT o_orderkey, CAST({_SERIAL} AS DOUBLE) AS datevalue, CAST({_SERIAL} AS DOUBLE) AS slashes,
       round((((o_orderkey % 12 + 1) % 12 + CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 0 END) * 3600 + o_orderkey % 60 * 60) / 86400, 8) AS timevalue,
       CAST({_SERIAL} + date_diff('day', {_DAY}, list_filter(generate_series({_DAY} + INTERVAL 1 DAY, {_DAY} + INTERVAL 20 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 7)[10]::DATE) AS DOUBLE) AS workday
FROM orders""",
    "row_lookups": """
SELECT c_custkey, round(c_acctbal * k, 4) AS hlookup, round(c_acctbal * k, 4) AS vlookup, round(c_acctbal * k, 4) AS "index", CAST(k % 3 + 1 AS DOUBLE) AS xmatch, 2.0::DOUBLE AS smaller, 3.0::DOUBLE AS larger,
       'a, ' || c_mktsegment AS transposed, CASE k WHEN 1 THEN 'a, c, b' WHEN 2 THEN 'c, a, b' ELSE 'c, b, a' END AS sortby
FROM (SELECT *, c_nationkey % 3 + 1 AS k FROM customer)""",
    "further_statistics": """
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS stdev, round(stddev_pop(l_quantity), 6) AS stdevp, round(var_samp(l_quantity), 5) AS var, round(var_pop(l_quantity), 5) AS varp,
       round(quantile_cont(l_extendedprice, 0.3), 4) AS p30, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(sum(l_quantity), 4) AS total
FROM lineitem GROUP BY 1""",
    "forecasts": """
SELECT l_orderkey, l_linenumber, round((3 * q + 3 * t + 3) / 3 + 3 * (2 * t + 3) / 2, 4) AS linear, q AS middle, round(q + 2 * 1.959963985, 4) AS upper
FROM (SELECT *, l_quantity AS q, l_tax * 100 AS t FROM lineitem)""",
    "format_stops": """
WITH g AS (SELECT c_mktsegment, min(c_acctbal) AS a, max(c_acctbal) AS b, list_sort(list(c_acctbal)) AS l FROM customer GROUP BY 1),
     w AS (SELECT min(c_acctbal) AS wa, max(c_acctbal) AS wb, list_sort(list(c_acctbal)) AS wl FROM customer),
     p AS (SELECT wa + (wb - wa) * 0.9 AS far, wl[CAST(ceil((len(wl) - 1) * 0.33) AS INTEGER) + 1] AS third, wl[CAST(ceil((len(wl) - 1) * 0.67) AS INTEGER) + 1] AS two FROM w),
     m AS (SELECT c_custkey, c_acctbal AS v, a, b, l[CAST(ceil((len(l) - 1) * 0.5) AS INTEGER) + 1] AS mid FROM customer JOIN g USING (c_mktsegment)),
     t AS (SELECT *, v <= mid AS lower, CASE WHEN v <= mid THEN (v - a) / (mid - a) ELSE (v - mid) / (b - mid) END AS s FROM m)
SELECT c_custkey, printf('%02X%02X%02X', CAST(floor(CASE WHEN lower THEN 248 + s * 7 ELSE 255 - s * 156 END + 0.5) AS INTEGER), CAST(floor(CASE WHEN lower THEN 105 + s * 130 ELSE 235 - s * 45 END + 0.5) AS INTEGER),
         CAST(floor(CASE WHEN lower THEN 107 + s * 25 ELSE 132 - s * 9 END + 0.5) AS INTEGER)) AS color,
       round(greatest(0, least(1, v / far)) * 100, 6) AS bar, CASE WHEN v > two THEN 2 WHEN v >= third THEN 1 ELSE 0 END AS icon,
       CASE WHEN v > 5000 THEN 'bold' WHEN v < 0 THEN 'red' WHEN v > 4000 THEN 'blue,plain' WHEN v > 3000 THEN 'plain' ELSE '' END AS styles
FROM t, p""",
}
