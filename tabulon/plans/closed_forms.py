"""More of the catalogue's tables: functions held against closed forms, round trips and numeric integrals in SQL."""

from __future__ import annotations

from .lazy import F, agg, c, fn
from .registry import grouped, scalars


def integral(f, a: str, b: str, n: int = 200) -> str:
    """SQL of Simpson's rule for f, which makes SQL of SQL, over [a, b]."""
    x = f"(({a}) + i * (({b}) - ({a})) / {n}.0)"
    return f"((({b}) - ({a})) / {3 * n}.0 * list_sum(list_transform(range(0, {n + 1}), lambda i: (CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f(x)}))))"


size, pk = c("p_size"), c("p_partkey")
x, X = size / 20, "(p_size / 20.0)"
p, P = size / 51, "(p_size / 51.0)"


def phi(z: str) -> str:
    return f"(0.5 + {integral(lambda t: f'exp(-{t} * {t} / 2) / sqrt(2 * pi())', '0', z)})"


Z = f"({X} - 1)"
scalars("normal_integrals", "part", ["p_partkey"], {
    "erf_": (fn.ERF(x), f"2 / sqrt(pi()) * {integral(lambda t: f'exp(-{t} * {t})', '0', X)}"),
    "erf_between": (fn.ERF(x, 3), f"2 / sqrt(pi()) * {integral(lambda t: f'exp(-{t} * {t})', X, '3')}"),
    "erf_precise": (fn.ERF_PRECISE(x), f"2 / sqrt(pi()) * {integral(lambda t: f'exp(-{t} * {t})', '0', X)}"),
    "erfc": (fn.ERFC(x), f"1 - 2 / sqrt(pi()) * {integral(lambda t: f'exp(-{t} * {t})', '0', X)}"),
    "erfc_precise": (fn.ERFC_PRECISE(x), f"1 - 2 / sqrt(pi()) * {integral(lambda t: f'exp(-{t} * {t})', '0', X)}"),
    "gauss": (fn.GAUSS(x - 1), f"{phi(Z)} - 0.5"), "normsdist": (fn.NORMSDIST(x - 1), phi(Z)), "norm_s_dist": (fn.NORM_S_DIST(x - 1, True), phi(Z)),
    "density": (fn.NORM_S_DIST(x - 1, False), f"exp(-{Z} * {Z} / 2) / sqrt(2 * pi())"),
    "normdist": (fn.NORMDIST(x * 2 + 1, 3, 2, True), phi(Z)), "lognormdist": (fn.LOGNORMDIST(F.exp(x * 2 + 1), 3, 2), phi(Z)),
    "norm_s_inv": (fn.NORM_S_INV(fn.NORM_S_DIST(x - 1, True)), Z), "normsinv": (fn.NORMSINV(fn.NORMSDIST(x - 1)), Z),
    "norm_inv": (fn.NORM_INV(fn.NORMDIST(x, 1, 2, True), 1, 2), X), "norminv": (fn.NORMINV(fn.NORMDIST(x, 1, 2, True), 1, 2), X),
    "lognorm_inv": (fn.LOGNORM_INV(fn.LOGNORM_DIST(x, 0, 1, True), 0, 1), X), "loginv": (fn.LOGINV(fn.LOGNORMDIST(x, 0, 1), 0, 1), X),
    "confidence": (fn.CONFIDENCE(2 * (1 - fn.NORMSDIST(x).value), 10, 25), f"{X} * 2"), "confidence_norm": (fn.CONFIDENCE_NORM(2 * (1 - fn.NORMSDIST(x).value), 10, 25), f"{X} * 2"),
}, {"p_size": c("p_size")})
e2, E2 = F.exp(-x / 2), f"exp(-{X} / 2)"
scalars("distribution_closed_forms", "part", ["p_partkey"], {
    "chisq": (fn.CHISQ_DIST(x, 4, True), f"1 - {E2} * (1 + {X} / 2)"), "chisq_density": (fn.CHISQ_DIST(x, 4, False), f"{X} * {E2} / 4"),
    "chisq_rt": (fn.CHISQ_DIST_RT(x, 4), f"{E2} * (1 + {X} / 2)"), "chidist": (fn.CHIDIST(x, 4), f"{E2} * (1 + {X} / 2)"),
    "chisq_inv": (fn.CHISQ_INV(p, 2), f"-2 * ln(1 - {P})"), "chisq_inv_rt": (fn.CHISQ_INV_RT(p, 2), f"-2 * ln({P})"), "chiinv": (fn.CHIINV(p, 2), f"-2 * ln({P})"),
    "t_": (fn.T_DIST(x - 1, 2, True), f"0.5 + {Z} / (2 * sqrt(2 + {Z} * {Z}))"), "t_rt": (fn.T_DIST_RT(x, 2), f"0.5 - {X} / (2 * sqrt(2 + {X} * {X}))"),
    "t_2t": (fn.T_DIST_2T(x, 2), f"1 - {X} / sqrt(2 + {X} * {X})"), "tdist": (fn.TDIST(x, 2, 1), f"0.5 - {X} / (2 * sqrt(2 + {X} * {X}))"),
    "t_inv": (fn.T_INV(p, 2), f"(2 * {P} - 1) / sqrt(2 * {P} * (1 - {P}))"), "t_inv_2t": (fn.T_INV_2T(p, 2), f"(1 - {P}) / sqrt({P} * (1 - {P} / 2))"), "tinv": (fn.TINV(p, 2), f"(1 - {P}) / sqrt({P} * (1 - {P} / 2))"),
    "confidence_t": (fn.CONFIDENCE_T(p, 6, 3), f"6 / sqrt(3) * (1 - {P}) / sqrt({P} * (1 - {P} / 2))"),
    "f_": (fn.F_DIST(x, 2, 6, True), f"1 - pow(6 / (6 + 2 * {X}), 3)"), "f_rt": (fn.F_DIST_RT(x, 2, 6), f"pow(6 / (6 + 2 * {X}), 3)"), "fdist": (fn.FDIST(x, 2, 6), f"pow(6 / (6 + 2 * {X}), 3)"),
    "f_inv": (fn.F_INV(p, 2, 6), f"3 * (pow(1 - {P}, -1 / 3.0) - 1)"), "f_inv_rt": (fn.F_INV_RT(p, 2, 6), f"3 * (pow({P}, -1 / 3.0) - 1)"), "finv": (fn.FINV(p, 2, 6), f"3 * (pow({P}, -1 / 3.0) - 1)"),
    "beta": (fn.BETA_DIST(p, 2, 3, True), f"6 * pow({P}, 2) - 8 * pow({P}, 3) + 3 * pow({P}, 4)"), "beta_density": (fn.BETA_DIST(p, 2, 3, False), f"12 * {P} * pow(1 - {P}, 2)"),
    "betadist": (fn.BETADIST(p * 4 + 1, 2, 3, 1, 5), f"6 * pow({P}, 2) - 8 * pow({P}, 3) + 3 * pow({P}, 4)"),
    "beta_inv": (fn.BETA_INV(p, 1, 3), f"1 - pow(1 - {P}, 1 / 3.0)"), "betainv": (fn.BETAINV(p, 3, 1), f"pow({P}, 1 / 3.0)"),
    "gamma_": (fn.GAMMA(x + 1), f"gamma({X} + 1)"), "gammaln_precise": (fn.GAMMALN_PRECISE(x + 1), f"lgamma({X} + 1)"),
    "gamma_dist": (fn.GAMMA_DIST(x, 3, 2, True), f"1 - {E2} * (1 + {X} / 2 + {X} * {X} / 8)"), "gammadist": (fn.GAMMADIST(x, 3, 2, False), f"{X} * {X} * {E2} / 16"),
    "gamma_inv": (fn.GAMMA_INV(p, 1, 2), f"-2 * ln(1 - {P})"), "gammainv": (fn.GAMMAINV(p, 1, 2), f"-2 * ln(1 - {P})"),
    "weibull": (fn.WEIBULL(x, 2, 3, True), f"1 - exp(-pow({X} / 3, 2))"), "expondist": (fn.EXPONDIST(x, 2, True), f"1 - exp(-2 * {X})"),
}, {"p_size": c("p_size")})
k, K = fn.MOD(size, 9), "(p_size % 9)"


def choose(n: str, m: str) -> str:
    return f"(factorial(({n})::int)::double / factorial(({m})::int) / factorial(({n} - {m})::int))"


def binom(m: str) -> str:
    return f"{choose('8', m)} * pow(0.3, {m}) * pow(0.7, 8 - {m})"


def summed(term, low: str, high: str) -> str:
    return f"list_sum(list_transform(range(({low})::bigint, ({high})::bigint + 1), lambda i: {term('i')}))"


least_k = f"list_min(list_filter(range(0, 9), lambda j: list_sum(list_transform(range(0, j + 1), lambda i: {binom('i')})) >= {P}))"
scalars("discrete_closed_forms", "part", ["p_partkey"], {
    "poisson": (fn.POISSON(k, 2.5, True), summed(lambda i: f"exp(-2.5) * pow(2.5, {i}) / factorial({i}::int)", "0", K)), "binomdist": (fn.BINOMDIST(k, 8, 0.3, True), f"CASE WHEN {K} = 8 THEN 1 ELSE {summed(binom, '0', K)} END"),
    "range_": (fn.BINOM_DIST_RANGE(8, 0.3, 2, 5), summed(binom, "2", "5")),
    "binom_inv": (fn.BINOM_INV(8, 0.3, p), least_k), "critbinom": (fn.CRITBINOM(8, 0.3, p), least_k),
    "hypgeom": (fn.HYPGEOM_DIST(fn.MOD(size, 4), 5, 7, 20, False), f"{choose('7', '(p_size % 4)')} * {choose('13', '(5 - p_size % 4)')} / {choose('20', '5')}"),
    "hypgeomdist": (fn.HYPGEOMDIST(fn.MOD(size, 4), 5, 7, 20), f"{choose('7', '(p_size % 4)')} * {choose('13', '(5 - p_size % 4)')} / {choose('20', '5')}"),
    "negbinomdist": (fn.NEGBINOMDIST(k, 3, 0.4), f"{choose(f'({K} + 2)', '2')} * pow(0.4, 3) * pow(0.6, {K})"),
}, {"p_size": c("p_size")})
scalars("bessel", "part", ["p_partkey"], {
    "j": (fn.BESSELJ(x * 4, 2), integral(lambda t: f"cos(2 * {t} - {X} * 4 * sin({t})) / pi()", "0", "pi()")),
    "i": (fn.BESSELI(x, 2), integral(lambda t: f"exp({X} * cos({t})) * cos(2 * {t}) / pi()", "0", "pi()")),
    "k": (fn.BESSELK(x + 1, 1), integral(lambda t: f"exp(-({X} + 1) * cosh({t})) * cosh({t})", "0", "6", 600)),
    "y": (fn.BESSELY(x + 1, 1), f"{integral(lambda t: f'sin(({X} + 1) * sin({t}) - {t}) / pi()', '0', 'pi()')} - {integral(lambda t: f'(exp({t}) - exp(-{t})) * exp(-({X} + 1) * sinh({t})) / pi()', '0', '6', 600)}"),
}, {"p_size": c("p_size")})

# ---- complex numbers ---------------------------------------------------------------------------
a, b, A, B = size / 25 - 1, (pk % 7) / 5 + 0.3, "(p_size / 25.0 - 1)", "((p_partkey % 7) / 5.0 + 0.3)"
z = fn.COMPLEX(a, b)
re, im = fn.IMREAL, fn.IMAGINARY
M2 = f"({A} * {A} + {B} * {B})"
COS2, COSH2 = f"(pow(cos({A}), 2) + pow(sinh({B}), 2))", f"(pow(sinh({A}), 2) + pow(cos({B}), 2))"
SIN2, SINH2 = f"(pow(sin({A}), 2) + pow(sinh({B}), 2))", f"(pow(sinh({A}), 2) + pow(sin({B}), 2))"
ARG = f"atan2({B}, {A})"
scalars("complex_functions", "part", ["p_partkey"], {
    "argument": (fn.IMARGUMENT(z), ARG), "conjugate": (im(fn.IMCONJUGATE(z)), f"-{B}"),
    "exp_re": (re(fn.IMEXP(z)), f"exp({A}) * cos({B})"), "exp_im": (im(fn.IMEXP(z)), f"exp({A}) * sin({B})"),
    "ln_re": (re(fn.IMLN(z)), f"ln({M2}) / 2"), "ln_im": (im(fn.IMLN(z)), ARG), "log10_re": (re(fn.IMLOG10(z)), f"ln({M2}) / 2 / ln(10)"), "log2_im": (im(fn.IMLOG2(z)), f"{ARG} / ln(2)"),
    "sqrt_re": (re(fn.IMSQRT(z)), f"pow({M2}, 0.25) * cos({ARG} / 2)"), "sqrt_im": (im(fn.IMSQRT(z)), f"pow({M2}, 0.25) * sin({ARG} / 2)"),
    "power_re": (re(fn.IMPOWER(z, 3)), f"pow({M2}, 1.5) * cos(3 * {ARG})"), "power_im": (im(fn.IMPOWER(z, 3)), f"pow({M2}, 1.5) * sin(3 * {ARG})"),
    "div_re": (re(fn.IMDIV(fn.COMPLEX(1, 2), z)), f"({A} + 2 * {B}) / {M2}"), "div_im": (im(fn.IMDIV(fn.COMPLEX(1, 2), z)), f"(2 * {A} - {B}) / {M2}"),
    "cos_re": (re(fn.IMCOS(z)), f"cos({A}) * cosh({B})"), "cos_im": (im(fn.IMCOS(z)), f"-sin({A}) * sinh({B})"),
    "sin_re": (re(fn.IMSIN(z)), f"sin({A}) * cosh({B})"), "sin_im": (im(fn.IMSIN(z)), f"cos({A}) * sinh({B})"),
    "cosh_re": (re(fn.IMCOSH(z)), f"cosh({A}) * cos({B})"), "cosh_im": (im(fn.IMCOSH(z)), f"sinh({A}) * sin({B})"),
    "sinh_re": (re(fn.IMSINH(z)), f"sinh({A}) * cos({B})"), "sinh_im": (im(fn.IMSINH(z)), f"cosh({A}) * sin({B})"),
    "tan_re": (re(fn.IMTAN(z)), f"sin({A}) * cos({A}) / {COS2}"), "tan_im": (im(fn.IMTAN(z)), f"sinh({B}) * cosh({B}) / {COS2}"),
    "cot_re": (re(fn.IMCOT(z)), f"sin({A}) * cos({A}) / {SIN2}"), "cot_im": (im(fn.IMCOT(z)), f"-sinh({B}) * cosh({B}) / {SIN2}"),
    "sec_re": (re(fn.IMSEC(z)), f"cos({A}) * cosh({B}) / {COS2}"), "sec_im": (im(fn.IMSEC(z)), f"sin({A}) * sinh({B}) / {COS2}"),
    "csc_re": (re(fn.IMCSC(z)), f"sin({A}) * cosh({B}) / {SIN2}"), "csc_im": (im(fn.IMCSC(z)), f"-cos({A}) * sinh({B}) / {SIN2}"),
    "sech_re": (re(fn.IMSECH(z)), f"cosh({A}) * cos({B}) / {COSH2}"), "sech_im": (im(fn.IMSECH(z)), f"-sinh({A}) * sin({B}) / {COSH2}"),
    "csch_re": (re(fn.IMCSCH(z)), f"sinh({A}) * cos({B}) / {SINH2}"), "csch_im": (im(fn.IMCSCH(z)), f"-cosh({A}) * sin({B}) / {SINH2}"),
}, {"p_size": c("p_size"), "p_partkey": pk % 7})

# ---- radix, numerals, logic, texts -------------------------------------------------------------
small, S = fn.MOD(pk, 512), "(p_partkey % 512)"
roman = "(['', 'M', 'MM', 'MMM'])[{n} // 1000 + 1] || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[{n} // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[{n} // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[{n} % 10 + 1]".replace("{n}", "(p_partkey % 4000)")
scalars("radix_numerals", "part", ["p_partkey"], {
    "v:bin2hex": (fn.BIN2HEX(fn.DEC2BIN(small)), f"upper(to_base({S}, 16))"), "v:bin2oct": (fn.BIN2OCT(fn.DEC2BIN(small)), f"to_base({S}, 8)"),
    "v:oct2bin": (fn.OCT2BIN(fn.DEC2OCT(small)), f"to_base({S}, 2)"), "v:oct2hex": (fn.OCT2HEX(fn.DEC2OCT(pk)), "upper(to_base(p_partkey, 16))"), "v:hex2bin": (fn.HEX2BIN(fn.DEC2HEX(small)), f"to_base({S}, 2)"),
    "v:roman": (fn.ROMAN(fn.MOD(pk, 4000)), roman), "arabic": (fn.ARABIC(fn.ROMAN(fn.MOD(pk, 4000))), "p_partkey % 4000"), "pi_": (fn.PI(), "pi()"),
    "v:between": (fn.AND(fn[">="](fn.RANDBETWEEN(3, 9), 3), fn["<="](fn.RAND(), 1)), "'TRUE'"),
}, apart=[({"p_partkey": pk % 512}, "bin2hex bin2oct oct2bin hex2bin"), ({"p_partkey": pk % 4000}, "roman arabic")])
t = c("p_name")
yes = lambda sql: f"CASE WHEN {sql} THEN 'TRUE' ELSE 'FALSE' END"
div = fn["/"](1, fn.MOD(pk, 2))
scalars("logic_information", "part", ["p_partkey"], {
    "v:true_": (fn.TRUE(), "'TRUE'"), "v:false_": (fn.FALSE(), "'FALSE'"), "v:not_": (fn.NOT(fn[">"](size, 25)), yes("p_size <= 25")),
    "v:iserr": (fn.ISERR(div), yes("p_partkey % 2 = 0")), "v:isna": (fn.ISNA(fn.IF(fn[">"](size, 25), fn.NA(), size)), yes("p_size > 25")), "v:err_na": (fn.ISERR(fn.NA()), "'FALSE'"),
    "v:islogical": (fn.ISLOGICAL(fn[">"](size, 25)), "'TRUE'"), "v:isnontext": (fn.ISNONTEXT(size), "'TRUE'"), "v:text_is": (fn.ISNONTEXT(t), "'FALSE'"),
    "v:t_": (fn.T(t), "p_name"), "v:t_number": (fn.T(size), "''"), "n_": (fn.N(size), "p_size"), "n_text": (fn.N(t), "0"), "unicode_": (fn.UNICODE(t), "unicode(p_name)"),
    "v:leftb": (fn.LEFTB(t, 3), "left(p_name, 3)"), "v:rightb": (fn.RIGHTB(t, 3), "right(p_name, 3)"), "v:midb": (fn.MIDB(t, 2, 4), "substr(p_name, 2, 4)"), "v:replaceb": (fn.REPLACEB(t, 2, 3, "**"), "left(p_name, 1) || '**' || substr(p_name, 5)"),
    "v:findb": (fn.FINDB("e", t), "CASE WHEN strpos(p_name, 'e') = 0 THEN '#VALUE!' ELSE strpos(p_name, 'e')::varchar END"), "v:searchb": (fn.SEARCHB("E", t), "CASE WHEN strpos(lower(p_name), 'e') = 0 THEN '#VALUE!' ELSE strpos(lower(p_name), 'e')::varchar END"),
    "v:valuetotext": (fn.VALUETOTEXT(t), "p_name"), "v:encodeurl": (fn.ENCODEURL(fn.CONCAT(t, " é/", size)), "url_encode(p_name || ' é/' || p_size)"), "v:hyperlink": (fn.HYPERLINK("http://a.b/c", t), "p_name"),
})

# ---- money -------------------------------------------------------------------------------------
r, R, n, N = size / 1000, "(p_size / 1000.0)", (pk % 30) + 2, "((p_partkey % 30) + 2)"
payment = fn.PMT(r, n, 1000)
PMT = f"(-1000 * {R} / (1 - pow(1 + {R}, -{N})))"


def balance(m: str) -> str:
    """What is owed after m payments."""
    return f"(1000 * pow(1 + {R}, {m}) + {PMT} * (pow(1 + {R}, {m}) - 1) / {R})"


scalars("money", "part", ["p_partkey"], {
    "rate": (fn.RATE(n, payment, 1000), R), "cumprinc": (fn.CUMPRINC(r, n, 1000, 1, n, 0), "-1000"), "cumprinc_part": (fn.CUMPRINC(r, n, 1000, 1, 2, 0), f"{balance('2')} - 1000"),
    "cumipmt": (fn.CUMIPMT(r, n, 1000, 1, 2, 0), f"2 * {PMT} - ({balance('2')} - 1000)"),
    "db": (fn.DB(10000, 1000, 6, 2, 12), "10000 * (1 - 0.319) * 0.319"),
    "tbillyield": (fn.TBILLYIELD(F.lit("2008-03-31").cast("date"), F.lit("2008-06-01").cast("date"), 90 + x), f"(100 - (90 + {X})) / (90 + {X}) * 360 / 62"),
    "tbilleq": (fn.TBILLEQ(F.lit("2008-03-31").cast("date"), F.lit("2008-06-01").cast("date"), x / 30), f"365 * ({X} / 30) / (360 - ({X} / 30) * 62)"),
}, {"p_size": c("p_size"), "p_partkey": pk % 30})
v, w = c("l_quantity"), c("l_extendedprice")
grouped("aggregates_by_flag", "lineitem", ["l_returnflag"], {
    "product_": (agg.PRODUCT(1 + c("l_discount") / 10000), "product(1 + l_discount / 10000)"), "mina": (agg.MINA(v), "min(l_quantity)"), "maxa": (agg.MAXA(v), "max(l_quantity)"), "vara": (agg.VARA(v), "var_samp(l_quantity)"), "varpa": (agg.VARPA(v), "var_pop(l_quantity)"),
    "stdeva": (agg.STDEVA(v), "stddev_samp(l_quantity)"), "stdevpa": (agg.STDEVPA(v), "stddev_pop(l_quantity)"), "var_": (agg.VAR(v), "var_samp(l_quantity)"), "varp": (agg.VARP(v), "var_pop(l_quantity)"), "stdev_": (agg.STDEV(v), "stddev_samp(l_quantity)"), "stdevp": (agg.STDEVP(v), "stddev_pop(l_quantity)"),
    "skewp": (agg["SKEW.P"](v), "avg(pow(l_quantity, 3)) / pow(stddev_pop(l_quantity), 3) - 3 * avg(l_quantity) * var_pop(l_quantity) / pow(stddev_pop(l_quantity), 3) - pow(avg(l_quantity) / stddev_pop(l_quantity), 3)"),
    "pearson": (agg.PEARSON(v, w), "corr(l_quantity, l_extendedprice)"), "covar": (agg.COVAR(v, w), "covar_pop(l_quantity, l_extendedprice)"), "percentile_": (agg.PERCENTILE(v, 0.3), "quantile_cont(l_quantity, 0.3)"), "quartile_inc": (agg["QUARTILE.INC"](v, 3), "quantile_cont(l_quantity, 0.75)"),
    "forecast_linear": (agg["FORECAST.LINEAR"](30, w, v), "regr_intercept(l_extendedprice, l_quantity) + 30 * regr_slope(l_extendedprice, l_quantity)"), "linest": (agg.LINEST(w, v), "regr_slope(l_extendedprice, l_quantity)"),
    "z_test": (agg["Z.TEST"](v, 25.45, 40), f"1 - {phi('((avg(l_quantity) - 25.45) / (40 / sqrt(count(*))))')}"), "ztest": (agg.ZTEST(v, 25.45, 40), f"1 - {phi('((avg(l_quantity) - 25.45) / (40 / sqrt(count(*))))')}"),
})
