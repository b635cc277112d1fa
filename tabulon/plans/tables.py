"""The catalogue's tables: one column per worksheet function or aggregate, with its SQL."""

from __future__ import annotations

from .lazy import F, agg, c, fn
from .registry import grouped, scalars

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


# ---- scalar functions ------------------------------------------------------------------------
def half_away(x: str, d: int) -> str:
    return f"sign({x}) * floor(abs({x}) * {10.0**d} + 0.5) / {10.0**d}"


bal = c("c_acctbal")
scalars("round_family", "customer", ["c_custkey"], {
    "round1": (fn.ROUND(bal, 1), half_away("c_acctbal", 1)),
    "round_neg": (fn.ROUND(bal, -2), "sign(c_acctbal) * floor(abs(c_acctbal) * 0.01 + 0.5) / 0.01"),
    "up": (fn.ROUNDUP(bal, 0), "sign(c_acctbal) * ceil(abs(c_acctbal))"),
    "down": (fn.ROUNDDOWN(bal, 0), "sign(c_acctbal) * floor(abs(c_acctbal))"),
    "trunc_": (fn.TRUNC(bal), "trunc(c_acctbal)"),
    "int_": (fn.INT(bal), "floor(c_acctbal)"),
    "abs_": (fn.ABS(bal), "abs(c_acctbal)"),
    "sign_": (fn.SIGN(bal), "sign(c_acctbal)"),
    "even_": (fn.EVEN(bal), "sign(c_acctbal) * ceil(abs(c_acctbal) / 2) * 2"),
    "odd_": (fn.ODD(bal), "CASE WHEN c_acctbal = 0 THEN 1 ELSE sign(c_acctbal) * (ceil((abs(c_acctbal) - 1) / 2) * 2 + 1) END"),
    "ceil_math": (fn.CEILING_MATH(bal, 7), "ceil(c_acctbal / 7) * 7"),
    "floor_math": (fn.FLOOR_MATH(bal, 7), "floor(c_acctbal / 7) * 7"),
    "ceil_precise": (fn.CEILING_PRECISE(bal, -7), "ceil(c_acctbal / 7) * 7"),
    "floor_precise": (fn.FLOOR_PRECISE(bal, -7), "floor(c_acctbal / 7) * 7"),
    "iso_ceiling": (fn.ISO_CEILING(bal, 5), "ceil(c_acctbal / 5) * 5"),
    "mround": (fn.MROUND(fn.ABS(bal), 25), "floor(abs(c_acctbal) / 25 + 0.5) * 25"),
    "v:ceil_sign": (fn.CEILING(bal, -10), "CASE WHEN c_acctbal > 0 THEN '#NUM!' ELSE (ceil(c_acctbal / -10) * -10)::bigint::varchar END"),
    "v:floor_sign": (fn.FLOOR(bal, -10), "CASE WHEN c_acctbal > 0 THEN '#NUM!' ELSE (floor(c_acctbal / -10) * -10)::bigint::varchar END"),
})
key, size = c("c_custkey"), c("p_size")
scalars("mod_quotient", "customer", ["c_custkey"], {
    "mod_pos": (fn.MOD(bal, 7), "c_acctbal - 7 * floor(c_acctbal / 7)"),
    "mod_neg": (fn.MOD(bal, -7), "c_acctbal + 7 * floor(c_acctbal / -7)"),
    "quotient": (fn.QUOTIENT(bal, 7), "trunc(c_acctbal / 7)"),
    "v:div0": (fn.QUOTIENT(bal, fn.MOD(key, 3)), "CASE WHEN c_custkey % 3 = 0 THEN '#DIV/0!' ELSE trunc(c_acctbal / (c_custkey % 3))::bigint::varchar END"),
    "v:iseven": (fn.ISEVEN(key), "CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END"),
    "v:isodd": (fn.ISODD(key), "CASE WHEN c_custkey % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END"),
    "gcd": (fn.GCD(key, 360), "gcd(c_custkey, 360)"),
    "lcm": (fn.LCM(key, 12), "lcm(c_custkey, 12)"),
    "operators": (fn["+"](fn["*"](bal, 2), fn["-"](fn["/"](bal, 4), fn["%"](key))), "c_acctbal * 2 + (c_acctbal / 4 - c_custkey / 100)"),
    "v:compare": (fn["<="](bal, 0), "CASE WHEN c_acctbal <= 0 THEN 'TRUE' ELSE 'FALSE' END"),
    "delta": (fn.DELTA(fn.MOD(key, 5), 2), "CASE WHEN c_custkey % 5 = 2 THEN 1 ELSE 0 END"),
    "gestep": (fn.GESTEP(bal, 1000), "CASE WHEN c_acctbal >= 1000 THEN 1 ELSE 0 END"),
})
u = c("l_discount") * 9 + 0.05
U = "(l_discount * 9 + 0.05)"
scalars("trigonometry", "lineitem", LINE, {
    "sin_": (fn.SIN(u), f"sin({U})"), "cos_": (fn.COS(u), f"cos({U})"), "tan_": (fn.TAN(u), f"tan({U})"),
    "sec": (fn.SEC(u), f"1 / cos({U})"), "csc": (fn.CSC(u), f"1 / sin({U})"), "cot_": (fn.COT(u), f"1 / tan({U})"),
    "asin_": (fn.ASIN(u), f"asin({U})"), "acos_": (fn.ACOS(u), f"acos({U})"), "atan_": (fn.ATAN(u), f"atan({U})"),
    "atan2_": (fn.ATAN2(u, 2), f"atan2(2, {U})"), "acot": (fn.ACOT(u), f"atan2(1, {U})"),
    "sinh_": (fn.SINH(u), f"sinh({U})"), "cosh_": (fn.COSH(u), f"cosh({U})"), "tanh_": (fn.TANH(u), f"tanh({U})"),
    "sech": (fn.SECH(u), f"1 / cosh({U})"), "csch": (fn.CSCH(u), f"1 / sinh({U})"), "coth": (fn.COTH(u), f"1 / tanh({U})"),
    "asinh_": (fn.ASINH(u), f"asinh({U})"), "acosh_": (fn.ACOSH(u + 1), f"acosh({U} + 1)"), "atanh_": (fn.ATANH(u), f"atanh({U})"),
    "acoth": (fn.ACOTH(u + 1), f"0.5 * ln(({U} + 2) / {U})"), "degrees_": (fn.DEGREES(u), f"degrees({U})"), "radians_": (fn.RADIANS(u), f"radians({U})"),
}, {"l_discount": c("l_discount")})
q = c("l_quantity")
scalars("powers_logs", "lineitem", LINE, {
    "sqrt_": (fn.SQRT(q), "sqrt(l_quantity)"), "sqrtpi": (fn.SQRTPI(q), "sqrt(l_quantity * pi())"), "exp_": (fn.EXP(u), f"exp({U})"),
    "ln_": (fn.LN(q), "ln(l_quantity)"), "log10_": (fn.LOG10(q), "log10(l_quantity)"), "log2": (fn.LOG(q, 2), "ln(l_quantity) / ln(2)"),
    "power": (fn.POWER(q, 1.5), "pow(l_quantity, 1.5)"), "caret": (fn["^"](q, -1), "1 / l_quantity"),
    "v:power_zero": (fn.POWER(fn.MOD(q, 2), 0), "CASE WHEN l_quantity::bigint % 2 = 0 THEN '#NUM!' ELSE '1' END"),
    "v:ln_error": (fn.IF(fn.ISERROR(fn.LN(q - 2)), "bad", "good"), "CASE WHEN l_quantity <= 2 THEN 'bad' ELSE 'good' END"),
    "seriessum": (fn.SERIESSUM(u, 0, 2, 1, -0.5, 0.25), f"1 - 0.5 * pow({U}, 2) + 0.25 * pow({U}, 4)"),
}, {"l_discount": c("l_discount"), "l_quantity": c("l_quantity")})
scalars("combinatorics", "part", ["p_partkey"], {
    "fact": (fn.FACT(fn.MOD(size, 12)), "factorial((p_size % 12)::int)"),
    "factdouble": (fn.FACTDOUBLE(fn.MOD(size, 12)), "coalesce(list_product(list_filter(range(1, (p_size % 12 + 1)::bigint), lambda i: i % 2 = (p_size % 12) % 2)), 1)"),
    "combin": (fn.COMBIN(size + 1, 2), "(p_size + 1) * p_size / 2.0"),
    "combina": (fn.COMBINA(size, 2), "(p_size + 1) * p_size / 2.0"),
    "permut": (fn.PERMUT(size + 1, 2), "(p_size + 1) * p_size"),
    "permutationa": (fn.PERMUTATIONA(size, 3), "pow(p_size, 3)"),
    "multinomial": (fn.MULTINOMIAL(2, 3, fn.MOD(size, 4)), "factorial((5 + p_size % 4)::int) / (12.0 * factorial((p_size % 4)::int))"),
}, {"p_size": c("p_size")})
scalars("bit_operations", "part", ["p_partkey"], {
    "bitand": (fn.BITAND(c("p_partkey"), 173), "p_partkey & 173"), "bitor": (fn.BITOR(c("p_partkey"), 173), "p_partkey | 173"),
    "bitxor": (fn.BITXOR(c("p_partkey"), 173), "xor(p_partkey, 173)"), "left_": (fn.BITLSHIFT(c("p_partkey"), 3), "p_partkey * 8"),
    "right_": (fn.BITRSHIFT(c("p_partkey"), 3), "floor(p_partkey / 8)"), "reverse": (fn.BITLSHIFT(c("p_partkey"), -2), "floor(p_partkey / 4)"),
})
pk = c("p_partkey")
scalars("radix", "part", ["p_partkey"], {
    "v:hex": (fn.DEC2HEX(pk), "upper(to_base(p_partkey, 16))"), "v:bin": (fn.DEC2BIN(fn.MOD(pk, 512), 10), "lpad(to_base(p_partkey % 512, 2), 10, '0')"),
    "v:oct": (fn.DEC2OCT(pk), "to_base(p_partkey, 8)"), "v:base36": (fn.BASE(pk, 36, 5), "lpad(to_base(p_partkey, 36), 5, '0')"),
    "v:negative": (fn.DEC2HEX(fn["-"](pk)), "CASE WHEN p_partkey = 0 THEN '0' ELSE upper(to_base(1099511627776 - p_partkey, 16)) END"),
    "hex2dec": (fn.HEX2DEC(fn.DEC2HEX(pk)), "p_partkey"), "bin2dec": (fn.BIN2DEC(fn.DEC2BIN(fn.MOD(pk, 512))), "p_partkey % 512"),
    "oct2dec": (fn.OCT2DEC(fn.DEC2OCT(pk)), "p_partkey"), "v:hex2oct": (fn.HEX2OCT(fn.DEC2HEX(pk)), "to_base(p_partkey, 8)"),
    "decimal": (fn.DECIMAL(fn.BASE(pk, 36), 36), "p_partkey"),
})
t = c("p_name")
scalars("text_case", "part", ["p_partkey"], {
    "v:upper_": (fn.UPPER(t), "upper(p_name)"), "v:lower_": (fn.LOWER(t), "lower(p_name)"), "len_": (fn.LEN(t), "length(p_name)"),
    "v:left_": (fn.LEFT(t, 3), "left(p_name, 3)"), "v:right_": (fn.RIGHT(t, 3), "right(p_name, 3)"), "v:mid": (fn.MID(t, 2, 4), "substr(p_name, 2, 4)"),
    "v:proper": (fn.PROPER(t), "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"),
    "v:trim_": (fn.TRIM(fn.CONCAT("  ", t, "   ")), "trim(regexp_replace('  ' || p_name || '   ', '\\s+', ' ', 'g'))"),
    "v:clean": (fn.CLEAN(fn.CONCAT(t, "\x07")), "p_name"), "v:rept": (fn.REPT(t, 2), "repeat(p_name, 2)"),
    "v:concat_": (fn.CONCATENATE(t, "/", size), "p_name || '/' || p_size"), "v:ampersand": (fn["&"](t, size), "p_name || p_size"),
    "v:textjoin": (fn.TEXTJOIN("-", True, t, "", c("p_type")), "p_name || '-' || p_type"),
    "v:exact": (fn.EXACT(t, fn.LOWER(t)), "CASE WHEN p_name = lower(p_name) THEN 'TRUE' ELSE 'FALSE' END"),
    "v:substitute": (fn.SUBSTITUTE(t, "e", "E"), "replace(p_name, 'e', 'E')"), "v:replace_": (fn.REPLACE(t, 2, 3, "**"), "left(p_name, 1) || '**' || substr(p_name, 5)"),
    "v:before": (fn.TEXTBEFORE(t, " "), "CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '#N/A' END"),
    "v:after": (fn.TEXTAFTER(t, " "), "CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '#N/A' END"),
    "v:find": (fn.FIND("e", t), "CASE WHEN strpos(p_name, 'e') = 0 THEN '#VALUE!' ELSE strpos(p_name, 'e')::varchar END"),
    "v:search": (fn.SEARCH("E", t), "CASE WHEN strpos(lower(p_name), 'e') = 0 THEN '#VALUE!' ELSE strpos(lower(p_name), 'e')::varchar END"),
    "code": (fn.CODE(t), "unicode(p_name)"), "v:char": (fn.CHAR(fn["+"](65, fn.MOD(pk, 26))), "chr((65 + p_partkey % 26)::int)"),
    "lenb": (fn.LENB(t), "length(p_name)"), "v:unichar": (fn.UNICHAR(fn["+"](945, fn.MOD(pk, 20))), "chr((945 + p_partkey % 20)::int)"),
})
dt = c("text")
scalars("text_regex", "documents", ["doc_id"], {
    "v:test": (fn.REGEXTEST(dt, "[0-9]{3}"), "CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'TRUE' ELSE 'FALSE' END"),
    "v:extract": (fn.REGEXEXTRACT(dt, "[0-9]+"), "CASE WHEN regexp_matches(text, '[0-9]+') THEN regexp_extract(text, '[0-9]+') ELSE '#N/A' END"),
    "v:replaced": (fn.REGEXREPLACE(dt, "[0-9]+", "#"), "regexp_replace(text, '[0-9]+', '#', 'g')"),
    "v:spaces": (fn.LEFT(fn.TRIM(dt), 40), "left(regexp_replace(text, '\\s+', ' ', 'g'), 40)"),
    "words": (F.size(fn.TEXTSPLIT(dt, " ").value), "len(string_split(text, ' '))"),
})
price = c("p_retailprice")
scalars("text_numbers", "part", ["p_partkey"], {
    "v:fixed": (fn.FIXED(price * 10, 1), "format('{:,.1f}', floor(p_retailprice * 100 + 0.5) / 10)"),
    "v:fixed_plain": (fn.FIXED(price * 10, 1, True), "format('{:.1f}', floor(p_retailprice * 100 + 0.5) / 10)"),
    "v:dollar": (fn.DOLLAR(price, 1), "'$' || format('{:,.1f}', floor(p_retailprice * 10 + 0.5) / 10)"),
    "value_": (fn.VALUE(fn.CONCAT("$", size, ",000.5")), "p_size * 1000 + 0.5"), "percent": (fn.VALUE(fn.CONCAT(size, "%")), "p_size / 100"),
    "numbervalue": (fn.NUMBERVALUE(fn.CONCAT(size, ".000,25"), ",", "."), "p_size * 1000 + 0.25"),
    "v:format": (fn.TEXT(price * 10, "#,##0.0"), "format('{:,.1f}', floor(p_retailprice * 100 + 0.5) / 10)"),
    "v:pad": (fn.TEXT(size, "0000"), "lpad(p_size::varchar, 4, '0')"), "v:share": (fn.TEXT(size / 100, "0%"), "p_size || '%'"),
})

# ---- dates -----------------------------------------------------------------------------------
d = c("o_orderdate")
D = "o_orderdate::date"
#: The cells below depend on the day only: different times of one day are one input, and days are few.
DAY = d.cast("date")
scalars("date_parts", "orders", ["o_orderkey"], {
    "y": (fn.YEAR(d), "year(o_orderdate)"), "m": (fn.MONTH(d), "month(o_orderdate)"), "dd": (fn.DAY(d), "day(o_orderdate)"),
    "serial": (fn.SERIAL(d.cast("date")), f"date_diff('day', DATE '1899-12-30', {D})"),
    "wd1": (fn.WEEKDAY(d), "dayofweek(o_orderdate) + 1"), "wd2": (fn.WEEKDAY(d, 2), "isodow(o_orderdate)"), "wd3": (fn.WEEKDAY(d, 3), "isodow(o_orderdate) - 1"),
    "iso": (fn.ISOWEEKNUM(d), "weekofyear(o_orderdate)"), "wn21": (fn.WEEKNUM(d, 21), "weekofyear(o_orderdate)"),
    "wn1": (fn.WEEKNUM(d), "floor((dayofyear(o_orderdate) - 1 + dayofweek(date_trunc('year', o_orderdate))) / 7) + 1"),
    "v:edate": (fn.EDATE(d, 3), f"({D} + INTERVAL 3 MONTH)::date::varchar"), "v:eomonth": (fn.EOMONTH(d, 1), f"last_day({D} + INTERVAL 1 MONTH)::varchar"),
    "v:date_": (fn.DATE(fn.YEAR(d), 15, fn.DAY(d)), "(make_date(year(o_orderdate) + 1, 3, 1) + INTERVAL 1 DAY * (day(o_orderdate) - 1))::date::varchar"),
    "days_": (fn.DAYS(F.lit("2002-01-01").cast("date"), d), f"date_diff('day', {D}, DATE '2002-01-01')"),
    "datevalue": (fn.DATEVALUE(F.date_format(d, "M/d/yyyy")), f"date_diff('day', DATE '1899-12-30', {D})"),
    "v:shown": (fn.TEXT(d, "yyyy-mm-dd"), "strftime(o_orderdate, '%Y-%m-%d')"),
}, {"o_orderdate": DAY})
end = F.lit("2002-03-15").cast("date")
scalars("date_spans", "orders", ["o_orderkey"], {
    "years": (fn.DATEDIF(d, end, "Y"), f"date_sub('year', {D}, DATE '2002-03-15')"), "months": (fn.DATEDIF(d, end, "M"), f"date_sub('month', {D}, DATE '2002-03-15')"),
    "days_": (fn.DATEDIF(d, end, "D"), f"date_diff('day', {D}, DATE '2002-03-15')"), "ym": (fn.DATEDIF(d, end, "YM"), f"date_sub('month', {D}, DATE '2002-03-15') % 12"),
    "yf2": (fn.YEARFRAC(d, end, 2), f"date_diff('day', {D}, DATE '2002-03-15') / 360.0"), "yf3": (fn.YEARFRAC(d, end, 3), f"date_diff('day', {D}, DATE '2002-03-15') / 365.0"),
    "yf4": (fn.YEARFRAC(d, end, 4), f"((2002 - year({D})) * 360 + (3 - month({D})) * 30 + 15 - least(day({D}), 30)) / 360.0"),
    "d360": (fn.DAYS360(d, end, True), f"(2002 - year({D})) * 360 + (3 - month({D})) * 30 + 15 - least(day({D}), 30)"),
    "v:wrong": (fn.DATEDIF(end, d, "D"), "'#NUM!'"),
}, {"o_orderdate": DAY})
near = F.date_add(d.cast("date"), 40)
scalars("networkdays", "orders", ["o_orderkey"], {
    "work": (fn.NETWORKDAYS(d, near), f"len(list_filter(range(0, 41), lambda i: isodow({D} + i::int) < 6))"),
    "holidays": (fn.NETWORKDAYS(d, near, ["1997-01-01", "1997-12-25", "1998-12-25"]), f"len(list_filter(range(0, 41), lambda i: isodow({D} + i::int) < 6 AND ({D} + i::int) NOT IN (DATE '1997-01-01', DATE '1997-12-25', DATE '1998-12-25')))"),
    "sundays": (fn.NETWORKDAYS_INTL(d, near, 11), f"len(list_filter(range(0, 41), lambda i: isodow({D} + i::int) < 7))"),
    "v:workday": (fn.WORKDAY(d, 10), f"({D} + list_filter(range(1, 20), lambda i: isodow({D} + i::int) < 6)[10]::int)::varchar"),
    "v:before": (fn.WORKDAY(d, -5), f"({D} - list_filter(range(1, 20), lambda i: isodow({D} - i::int) < 6)[5]::int)::varchar"),
}, {"o_orderdate": DAY})
ts = c("ts")
scalars("clock", "events", ["event_id"], {
    "h": (fn.HOUR(ts), "hour(ts)"), "mi": (fn.MINUTE(ts), "minute(ts)"), "s": (fn.SECOND(ts), "second(ts)"),
    "time_": (fn.TIME(fn.HOUR(ts), fn.MINUTE(ts), 0), "(hour(ts) * 3600 + minute(ts) * 60) / 86400.0"),
    "timevalue": (fn.TIMEVALUE(F.date_format(ts, "H:mm")), "(hour(ts) * 3600 + minute(ts) * 60) / 86400.0"),
})

# ---- logic -----------------------------------------------------------------------------------
v = c("value")
kind = c("event_type")
scalars("logic", "events", ["event_id"], {
    "v:if_": (fn.IF(fn[">"](v, 100), "high", "low"), "CASE WHEN value > 100 THEN 'high' ELSE 'low' END"),
    "v:ifs": (fn.IFS(fn["<"](v, 10), "a", fn["<"](v, 100), "b"), "CASE WHEN value < 10 THEN 'a' WHEN value < 100 THEN 'b' ELSE '#N/A' END"),
    "v:switch_": (fn.SWITCH(kind, "click", "1", "view", "2", "other"), "CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2' ELSE 'other' END"),
    "v:choose": (fn.CHOOSE(fn["+"](fn.MOD(c("event_id"), 3), 1), "x", "y", "z"), "['x', 'y', 'z'][event_id % 3 + 1]"),
    "v:and_": (fn.AND(fn[">"](v, 10), fn["="](kind, "CLICK")), "CASE WHEN value > 10 AND event_type = 'click' THEN 'TRUE' ELSE 'FALSE' END"),
    "v:or_": (fn.OR(fn[">"](v, 300), fn["="](kind, "error")), "CASE WHEN value > 300 OR event_type = 'error' THEN 'TRUE' ELSE 'FALSE' END"),
    "v:xor_": (fn.XOR(fn[">"](v, 50), fn["="](kind, "view")), "CASE WHEN (value > 50) <> (event_type = 'view') THEN 'TRUE' ELSE 'FALSE' END"),
    "iferror": (fn.IFERROR(fn["/"](v, fn.MOD(c("event_id"), 2)), -1), "CASE WHEN event_id % 2 = 0 THEN -1 ELSE value END"),
    "v:ifna": (fn.IFNA(fn.IFS(fn["="](kind, "view"), "yes"), "no"), "CASE WHEN event_type = 'view' THEN 'yes' ELSE 'no' END"),
    "error_type": (fn.IFERROR(fn.ERROR_TYPE(fn["/"](v, fn.MOD(c("event_id"), 2))), 0), "CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END"),
    "v:isnumber": (fn.ISNUMBER(v), "'TRUE'"), "v:istext": (fn.ISTEXT(kind), "'TRUE'"), "v:isblank": (fn.ISBLANK(F.nullif(kind, F.lit("view"))), "CASE WHEN event_type = 'view' THEN 'TRUE' ELSE 'FALSE' END"),
    "let_": (fn.LET(v, 2.0, lambda a, b: a * b + a), "value * 3"), "type_": (fn.TYPE(kind), "2"),
    "map_reduce": (fn.REDUCE(0.0, fn.MAP(F.array(v, v + 1), lambda x: x * 2).value, lambda a, x: a + x), "4 * value + 2"),
})

# ---- distributions ---------------------------------------------------------------------------
z = (q - 25) / 12
Z = "((l_quantity - 25) / 12)"
scalars("normal", "lineitem", LINE, {
    "phi": (fn.PHI(z), f"exp(-{Z} * {Z} / 2) / sqrt(2 * pi())"), "density": (fn.NORM_DIST(q, 25, 12, False), f"exp(-{Z} * {Z} / 2) / sqrt(2 * pi()) / 12"),
    "standardize": (fn.STANDARDIZE(q, 25, 12), Z), "fisher": (fn.FISHER(c("l_discount")), "atanh(l_discount)"), "fisherinv": (fn.FISHERINV(z), f"tanh({Z})"),
    "expon": (fn.EXPON_DIST(q, 0.1, True), "1 - exp(-0.1 * l_quantity)"), "weibull": (fn.WEIBULL_DIST(q, 1.5, 20, True), "1 - exp(-pow(l_quantity / 20, 1.5))"),
    "gammaln": (fn.GAMMALN(q), "lgamma(l_quantity)"), "lognormal": (fn.LOGNORM_DIST(q, 3, 1, False), "exp(-pow(ln(l_quantity) - 3, 2) / 2) / sqrt(2 * pi()) / l_quantity"),
}, {"l_discount": c("l_discount"), "l_quantity": c("l_quantity")})
k = fn.MOD(size, 10)
scalars("discrete", "part", ["p_partkey"], {
    "binom": (fn.BINOM_DIST(k, 12, 0.3, False), "exp(lgamma(13) - lgamma(p_size % 10 + 1) - lgamma(13 - p_size % 10) + (p_size % 10) * ln(0.3) + (12 - p_size % 10) * ln(0.7))"),
    "binom_cdf": (fn.BINOM_DIST(k, 12, 0.3, True), "list_sum(list_transform(range(0, (p_size % 10 + 1)::bigint), lambda i: exp(lgamma(13) - lgamma(i + 1) - lgamma(13 - i) + i * ln(0.3) + (12 - i) * ln(0.7))))"),
    "poisson": (fn.POISSON_DIST(k, 4.5, True), "list_sum(list_transform(range(0, (p_size % 10 + 1)::bigint), lambda i: exp(i * ln(4.5) - 4.5 - lgamma(i + 1))))"),
    "negbinom": (fn.NEGBINOM_DIST(k, 3, 0.4, False), "exp(lgamma(p_size % 10 + 3) - lgamma(3) - lgamma(p_size % 10 + 1) + 3 * ln(0.4) + (p_size % 10) * ln(0.6))"),
}, {"p_size": c("p_size")})

# ---- finance ---------------------------------------------------------------------------------
rate, total = 0.06 / 12, c("o_totalprice")
A = "pow(1.005, 36)"
scalars("annuities", "orders", ["o_orderkey"], {
    "pmt": (fn.PMT(rate, 36, total), f"-o_totalprice * {A} * 0.005 / ({A} - 1)"), "fv": (fn.FV(rate, 36, -100, total), f"-(o_totalprice * {A} - 100 * ({A} - 1) / 0.005)"),
    "pv": (fn.PV(rate, 36, total), f"-o_totalprice * ({A} - 1) / 0.005 / {A}"),
    "ipmt1": (fn.IPMT(rate, 1, 36, total), "-o_totalprice * 0.005"), "ppmt1": (fn.PPMT(rate, 1, 36, total), f"-o_totalprice * {A} * 0.005 / ({A} - 1) + o_totalprice * 0.005"),
    "nper": (fn.NPER(rate, fn["-"](fn["/"](total, 20)), total), "ln(0.05 / (0.05 - 0.005)) / ln(1.005)"),
    "ispmt": (fn.ISPMT(rate, 3, 36, total), "o_totalprice * 0.005 * (3 / 36.0 - 1)"), "rri": (fn.RRI(5, 1000, total), "pow(o_totalprice / 1000, 0.2) - 1"),
    "pduration": (fn.PDURATION(0.05, 1000, total), "(ln(o_totalprice) - ln(1000)) / ln(1.05)"), "effect": (fn.EFFECT(0.05, 4), "pow(1 + 0.05 / 4, 4) - 1"), "nominal": (fn.NOMINAL(0.05, 4), "(pow(1.05, 0.25) - 1) * 4"),
})
scalars("depreciation", "orders", ["o_orderkey"], {
    "sln": (fn.SLN(total, 100, 8), "(o_totalprice - 100) / 8"), "syd": (fn.SYD(total, 100, 8, 3), "(o_totalprice - 100) * 6 * 2 / 72"),
    "ddb2": (fn.DDB(total, 0, 8, 2), "o_totalprice * 0.75 * 0.25"), "vdb_straight": (fn.VDB(total, 0, 10, 0, 1, 1), "o_totalprice / 10"),
    "dollarde": (fn.DOLLARDE(1.02, 16), "1.125"), "dollarfr": (fn.DOLLARFR(1.125, 16), "1.02"),
})
M = "DATE '2002-06-30'"
due = F.lit("2002-06-30").cast("date")
scalars("bills", "orders", ["o_orderkey"], {
    "disc": (fn.DISC(d, due, 95, 100, 3), f"5 / (100 * date_diff('day', {D}, {M}) / 365.0)"), "intrate": (fn.INTRATE(d, due, 95, 100, 2), f"5 / 95.0 / (date_diff('day', {D}, {M}) / 360.0)"),
    "received": (fn.RECEIVED(d, due, 95, 0.01, 2), f"95 / (1 - 0.01 * date_diff('day', {D}, {M}) / 360.0)"), "pricedisc": (fn.PRICEDISC(d, due, 0.01, 100, 2), f"100 - 0.01 * 100 * date_diff('day', {D}, {M}) / 360.0"),
    "yielddisc": (fn.YIELDDISC(d, due, 95, 100, 3), f"5 / 95.0 / (date_diff('day', {D}, {M}) / 365.0)"), "accrintm": (fn.ACCRINTM(d, due, 0.05, 1000, 3), f"1000 * 0.05 * date_diff('day', {D}, {M}) / 365.0"),
    "v:tbillprice": (fn.IF(fn.ISERROR(fn.TBILLPRICE(d, due, 0.05)), "none", "some"), f"CASE WHEN date_diff('day', {D}, {M}) > 365 THEN 'none' ELSE 'some' END"),
}, {"o_orderdate": DAY})

# ---- engineering -----------------------------------------------------------------------------
scalars("units", "part", ["p_partkey"], {
    "ft": (fn.CONVERT(size, "m", "ft"), "p_size / 0.3048"), "celsius": (fn.CONVERT(size, "F", "C"), "(p_size + 459.67) * 5 / 9 - 273.15"),
    "v:mismatch": (fn.CONVERT(size, "m", "kg"), "'#N/A'"), "euro": (fn.EUROCONVERT(size, "DEM", "EUR", True), "p_size / 1.95583"),
    "imabs": (fn.IMABS(fn.COMPLEX(size, 3)), "sqrt(p_size * p_size + 9)"), "imreal": (fn.IMREAL(fn.IMPRODUCT(fn.COMPLEX(size, 1), "2-3i")), "p_size * 2 + 3"),
    "imaginary": (fn.IMAGINARY(fn.IMSUB("1+i", fn.COMPLEX(size, size))), "1 - p_size"), "v:imsum": (fn.IMSUM(fn.COMPLEX(size, 2), "1-5i"), "(p_size + 1) || '-3i'"),
}, {"p_size": c("p_size")})


# ---- aggregates ------------------------------------------------------------------------------
bal, qty, ext, disc = c("c_acctbal"), c("l_quantity"), c("l_extendedprice"), c("l_discount")
grouped("stats_by_nation", "customer", ["c_nationkey"], {
    "sum_": (agg.SUM(bal), "sum(c_acctbal)"), "avg_": (agg.AVERAGE(bal), "avg(c_acctbal)"), "n": (agg.COUNT(bal), "count(c_acctbal)"), "na": (agg.COUNTA(c("c_name")), "count(c_name)"),
    "min_": (agg.MIN(bal), "min(c_acctbal)"), "max_": (agg.MAX(bal), "max(c_acctbal)"), "sd": (agg.STDEV_S(bal), "stddev_samp(c_acctbal)"), "sdp": (agg.STDEV_P(bal), "stddev_pop(c_acctbal)"),
    "var_": (agg.VAR_S(bal), "var_samp(c_acctbal)"), "varp": (agg.VAR_P(bal), "var_pop(c_acctbal)"), "skew": (agg.SKEW(bal), "skewness(c_acctbal)"), "kurt": (agg.KURT(bal), "kurtosis(c_acctbal)"),
    "median_": (agg.MEDIAN(bal), "median(c_acctbal)"), "p90": (agg.PERCENTILE_INC(bal, 0.9), "quantile_cont(c_acctbal, 0.9)"), "q1": (agg.QUARTILE(bal, 1), "quantile_cont(c_acctbal, 0.25)"),
    "sumsq": (agg.SUMSQ(bal / 100), "sum(c_acctbal * c_acctbal / 10000)"), "devsq": (agg.DEVSQ(bal), "var_pop(c_acctbal) * count(*)"),
    "third": (agg.LARGE(bal, 3), "list_reverse_sort(list(c_acctbal))[3]"), "second": (agg.SMALL(bal, 2), "list_sort(list(c_acctbal))[2]"),
    "averagea": (agg.AVERAGEA(bal), "avg(c_acctbal)"),
})
grouped("means_by_flag", "lineitem", ["l_returnflag", "l_linestatus"], {
    "geomean": (agg.GEOMEAN(qty), "exp(avg(ln(l_quantity)))"), "harmean": (agg.HARMEAN(qty), "count(*) / sum(1 / l_quantity)"),
    "quartile_exc": (agg.QUARTILE_EXC(qty, 3), "list_sort(list(l_quantity))[floor(0.75 * (count(*) + 1))::bigint] + (0.75 * (count(*) + 1) - floor(0.75 * (count(*) + 1))) * (list_sort(list(l_quantity))[floor(0.75 * (count(*) + 1))::bigint + 1] - list_sort(list(l_quantity))[floor(0.75 * (count(*) + 1))::bigint])"),
    "subtotal9": (agg.SUBTOTAL(109, qty), "sum(l_quantity)"), "aggregate14": (agg.AGGREGATE(14, 6, ext, 1), "max(l_extendedprice)"),
    "sumproduct": (agg.SUMPRODUCT(qty, disc), "sum(l_quantity * l_discount)"), "sumxmy2": (agg.SUMXMY2(qty, disc), "sum(pow(l_quantity - l_discount, 2))"),
    "sumx2my2": (agg.SUMX2MY2(qty, disc), "sum(l_quantity * l_quantity - l_discount * l_discount)"), "sumx2py2": (agg.SUMX2PY2(qty, disc), "sum(l_quantity * l_quantity + l_discount * l_discount)"),
    "percentof": (agg.PERCENTOF(F.when(disc > 0.05, ext), ext), "sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice END) / sum(l_extendedprice)"),
})
grouped("regression", "lineitem", ["l_returnflag"], {
    "correl": (agg.CORREL(ext, qty), "corr(l_extendedprice, l_quantity)"), "covar": (agg.COVARIANCE_P(ext, qty), "covar_pop(l_extendedprice, l_quantity)"), "covar_s": (agg.COVARIANCE_S(ext, qty), "covar_samp(l_extendedprice, l_quantity)"),
    "slope": (agg.SLOPE(ext, qty), "regr_slope(l_extendedprice, l_quantity)"), "intercept": (agg.INTERCEPT(ext, qty), "regr_intercept(l_extendedprice, l_quantity)"), "rsq": (agg.RSQ(ext, qty), "regr_r2(l_extendedprice, l_quantity)"),
    "steyx": (agg.STEYX(ext, qty), "sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2))"),
    "forecast": (agg.FORECAST(60, ext, qty), "regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * 60"), "trend": (agg.TREND(ext, qty, 60, False), "sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity) * 60"),
    "growth": (agg.GROWTH(ext, qty, 10), "exp(regr_intercept(ln(l_extendedprice), l_quantity) + regr_slope(ln(l_extendedprice), l_quantity) * 10)"), "logest": (agg.LOGEST(ext, qty), "exp(regr_slope(ln(l_extendedprice), l_quantity))"),
}, 3)
ship = c("l_shipdate")
grouped("criteria", "lineitem", ["l_linestatus"], {
    "sumifs": (agg.SUMIFS(ext, c("l_returnflag"), "R", qty, ">25"), "coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25), 0)"), "countifs": (agg.COUNTIFS(qty, ">=40", disc, "<0.05"), "count(*) FILTER (WHERE l_quantity >= 40 AND l_discount < 0.05)"),
    "averageifs": (agg.AVERAGEIFS(ext, c("l_returnflag"), "<>a"), "avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'A')"), "minifs": (agg.MINIFS(ext, qty, 10), "min(l_extendedprice) FILTER (WHERE l_quantity = 10)"),
    "maxifs": (agg.MAXIFS(ext, qty, "<5"), "max(l_extendedprice) FILTER (WHERE l_quantity < 5)"), "sumif": (agg.SUMIF(qty, "<>3"), "sum(l_quantity) FILTER (WHERE l_quantity <> 3)"), "averageif": (agg.AVERAGEIF(qty, ">30", ext), "avg(l_extendedprice) FILTER (WHERE l_quantity > 30)"),
})
grouped("countif_wildcard", "part", ["p_brand"], {
    "starts": (agg.COUNTIF(c("p_name"), "s*"), "count(*) FILTER (WHERE lower(p_name) LIKE 's%')"), "inner_": (agg.COUNTIF(c("p_name"), "*E?"), "count(*) FILTER (WHERE lower(p_name) LIKE '%e_')"), "not_": (agg.COUNTIF(c("p_type"), "<>promo"), "count(*) FILTER (WHERE lower(p_type) <> 'promo')"),
    "blank": (agg.COUNTIF(F.nullif(c("p_type"), F.lit("PROMO")), ""), "count(*) FILTER (WHERE p_type = 'PROMO')"), "blanks": (agg.COUNTBLANK(F.nullif(c("p_type"), F.lit("PROMO"))), "count(*) FILTER (WHERE p_type = 'PROMO')"),
})
