"""Special functions as SQL text that Spark and other engines read alike; every literal is cast to DOUBLE."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

# Wichura's AS241 rational approximations of the normal quantile, lowest power first.
AS241_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
AS241_MIDDLE = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
AS241_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)
# Hart's rational approximation of the normal tail, highest power first.
HART_TOP = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BOTTOM = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def horner(coefficients: list[float], x: str) -> str:
    """The polynomial in x, coefficients from the lowest power."""
    out = num(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {num(c)})"
    return out


def _ratio(pair: tuple[list[float], list[float]], x: str) -> str:
    return f"({horner(pair[0], x)} / {horner(pair[1], x)})"


def norm_ppf(p: str) -> str:
    """The standard normal quantile of p strictly between 0 and 1."""
    q = f"(({p}) - {num(0.5)})"
    r = f"sqrt(-ln(least(({p}), 1 - ({p}))))"
    sign = f"(CASE WHEN {q} < 0 THEN {num(-1.0)} ELSE {num(1.0)} END)"
    centre = f"{q} * {_ratio(AS241_CENTRE, f'({num(0.180625)} - {q} * {q})')}"
    return f"(CASE WHEN abs({q}) <= {num(0.425)} THEN {centre} WHEN {r} <= {num(5.0)} THEN {sign} * {_ratio(AS241_MIDDLE, f'({r} - {num(1.6)})')} ELSE {sign} * {_ratio(AS241_TAIL, f'({r} - {num(5.0)})')} END)"


def norm_cdf(x: str) -> str:
    a = f"abs({x})"
    near = f"(exp(-{a} * {a} / 2) * {horner(HART_TOP[::-1], a)} / {horner(HART_BOTTOM[::-1], a)})"
    far = f"(exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + {num(0.65)}))))) / {num(2.506628274631)})"
    tail = f"(CASE WHEN {a} > 37 THEN {num(0.0)} WHEN {a} < {num(7.07106781186547)} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_sf2(z: str) -> str:
    """Two-sided normal p-value."""
    return f"(2 * (1 - {norm_cdf(f'abs({z})')}))"


def chi2_sf(x: str, df: int) -> str:
    """The upper tail of chi-square with an integer df, by its finite sum."""
    if df % 2 == 0:
        terms, c = [], 1.0
        for i in range(df // 2):
            c = c / i if i else 1.0
            terms.append(f"{num(c)} * power({x} / 2, {i})")
        return f"(exp(-({x}) / 2) * ({' + '.join(terms)}))"
    root, terms, c = f"sqrt({x})", [], 1.0
    for i in range(1, (df - 1) // 2 + 1):
        c /= 2 * i - 1
        terms.append(f"{num(c)} * power({root}, {2 * i - 1})")
    out = f"(2 * (1 - {norm_cdf(root)})"
    if terms:
        out += f" + {num((2 / 3.141592653589793) ** 0.5)} * exp(-({x}) / 2) * ({' + '.join(terms)})"
    return out + ")"


def t_ppf_upper(p: str, df: str) -> str:
    """Student's upper quantile for a small tail p, by a fifth-order expansion about the normal quantile."""
    z = norm_ppf(f"1 - ({p})")
    g1 = f"((power(z, 3) + z) / 4)"
    g2 = f"((5 * power(z, 5) + 16 * power(z, 3) + 3 * z) / 96)"
    g3 = f"((3 * power(z, 7) + 19 * power(z, 5) + 17 * power(z, 3) - 15 * z) / 384)"
    g4 = f"((79 * power(z, 9) + 776 * power(z, 7) + 1482 * power(z, 5) - 1920 * power(z, 3) - 945 * z) / 92160)"
    body = f"z + {g1} / ({df}) + {g2} / power({df}, 2) + {g3} / power({df}, 3) + {g4} / power({df}, 4)"
    return body.replace("z", f"({z})") if len(z) < 200 else f"({body.replace('z', 'Z_')})".replace("Z_", z)


def hash_bits(rep: str, i: str, seed: int | str, xor: str, shift: str) -> str:
    """A counter-based hash below 2^31 of two counters and a seed (a number or an expression); xor and shift are the
    engine's own forms, with {0} and {1}."""
    x0 = f"(({rep}) * 73856093 + ({i}) * 19349663 + {seed}) % 2147483647"
    x1 = f"(({xor.format(x0, shift.format(x0, 15))}) * 48271) % 2147483647"
    x2 = f"(({xor.format(x1, shift.format(x1, 13))}) * 69621) % 2147483647"
    return xor.format(x2, shift.format(x2, 16))


# --- Gamma and Student laws. Arguments are column names or short expressions, since the text repeats them.

# Stirling's series of ln gamma, in odd powers of 1 / x.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
#: Terms of the series and of the continued fraction below, enough up to a shape of GAMMA_LARGE.
GAMMA_SERIES, GAMMA_FRACTION, GAMMA_LARGE = 150, 80, 100.0
# The first coefficients of the gamma function's expansion in 1 / z.
GAMMA_INVERSE = [Fraction(1), Fraction(1, 12), Fraction(1, 288)]


def _series_product(p: list[Fraction], q: list[Fraction]) -> list[Fraction]:
    return [sum((p[i] * q[k - i] for i in range(k + 1)), Fraction(0)) for k in range(min(len(p), len(q)))]


def uniform_coefficients(terms: int = 14) -> list[list[Fraction]]:
    """Temme's C_0, C_1 and C_2 as power series in eta, where eta^2 / 2 = mu - ln(1 + mu).

    mu' mu = eta (1 + mu) gives the series of mu; then C_0 = 1 / mu - 1 / eta and C_k = C_(k-1)' / eta + (-1)^k g_k / mu.
    """
    n = terms + 8
    m = [Fraction(1)]  # mu / eta
    for k in range(1, n):
        # The coefficient of eta^(k+1): the sum over i + j = k of (i + 1) m_i m_j equals m_(k-1), and m_k stands in it k + 2 times.
        rest = sum(((i + 1) * m[i] * m[k - i] for i in range(1, k)), Fraction(0))
        m.append((m[k - 1] - rest) / (k + 2))
    inverse = [Fraction(1)]  # eta / mu
    for k in range(1, n):
        inverse.append(-sum((m[i] * inverse[k - i] for i in range(1, k + 1)), Fraction(0)))
    # Laurent series from eta^-1 on; the poles of a C_k cancel.
    out = [inverse[1:]]
    for k in (1, 2):
        d = [(i + 1) * c for i, c in enumerate(out[-1][1:])]  # C' from eta^0 on; divided by eta its first term is a pole
        pole = (-1) ** k * GAMMA_INVERSE[k]
        both = [x + pole * y for x, y in zip(d, inverse, strict=False)]
        out.append(both[1:])
    return [c[:terms] for c in out]


def ln_gamma(x: str) -> str:
    """ln of the gamma function of x > 0: Stirling's series at x + 10 less the ten factors between."""
    y = f"(({x}) + 10)"
    tail = " + ".join(f"{num(c)} / power({y}, {2 * k + 1})" for k, c in enumerate(STIRLING))
    factors = " * ".join(f"(({x}) + {k})" for k in range(10))
    return f"(({y} - {num(0.5)}) * ln({y}) - {y} + {num(0.9189385332046727)} + {tail} - ln({factors}))"


Steps = list[list[tuple[str, str]]]


def spark_fold(n: int, start: str, body: str) -> str:
    """body over s (so far) and k = n, n - 1 ... 1, from start, as Spark writes it."""
    return f"aggregate(sequence({n}, 1, -1), {start}, (s, k) -> {body})"


def sql_fold(n: int, start: str, body: str) -> str:
    """The same as DuckDB writes it."""
    return f"list_reduce(CAST(list_reverse(range(1, {n + 1})) AS DOUBLE[]), lambda s, k: {body}, {start})"


def gamma_steps(a: str, x: str, name: str, fold: Callable[[int, str, str], str] = spark_fold) -> Steps:
    """Columns {name}_p and {name}_q: the regularised lower and upper incomplete gamma functions of columns a > 0 and x, each
    without loss where it is small, in steps that build on each other. They are 0 and 1 for x <= 0.

    A series of fixed length up to x = a + 1, a continued fraction of fixed length beyond, and for large a Temme's uniform
    expansion.
    """
    v, mu, eta, front, low, high, rest = (f"{name}_{k}" for k in ("v", "mu", "eta", "front", "low", "high", "rest"))
    series = fold(GAMMA_SERIES, num(1.0), f"1 + {v} / ({a} + k) * s")
    fraction = fold(GAMMA_FRACTION, f"({v} + {2 * GAMMA_FRACTION + 1} - {a})", f"{v} + 2 * k - 1 - {a} - k * (k - {a}) / s")
    # mu - ln(1 + mu) loses digits near 0, where eta is mu (1 - mu / 3 + 7 mu^2 / 36 - ...).
    near = horner([1.0, -1 / 3, 7 / 36, -73 / 540, 1331 / 12960], mu)
    c = [horner([float(f) for f in k], eta) for k in uniform_coefficients()]
    root = f"({eta} * sqrt({a}))"
    large = f"{a} > {num(GAMMA_LARGE)}"
    return [
        [(v, f"CASE WHEN {x} > 0 THEN {x} ELSE {num(1e-300)} END")],
        [(mu, f"{v} / {a} - 1"), (front, f"exp({a} * ln({v}) - {v} - {ln_gamma(a)})")],
        [(eta, f"CASE WHEN abs({mu}) < {num(1e-3)} THEN {mu} * {near} ELSE sign({mu}) * sqrt(greatest(2 * ({mu} - ln({v} / {a})), 0)) END")],
        [
            (low, f"CASE WHEN {large} OR {x} >= {a} + 1 THEN NULL ELSE {front} / {a} * {series} END"),
            (high, f"CASE WHEN {large} OR {x} < {a} + 1 THEN NULL ELSE {front} / {fraction} END"),
            (rest, f"CASE WHEN {large} THEN exp(-{a} * {eta} * {eta} / 2) / sqrt({num(6.283185307179586)} * {a}) * ({c[0]} + {c[1]} / {a} + {c[2]} / ({a} * {a})) END"),
        ],
        [
            (f"{name}_p", f"CASE WHEN {x} <= 0 THEN {num(0.0)} WHEN {large} THEN {norm_cdf(root)} - {rest} WHEN {low} IS NOT NULL THEN {low} ELSE 1 - {high} END"),
            (f"{name}_q", f"CASE WHEN {x} <= 0 THEN {num(1.0)} WHEN {large} THEN {norm_cdf(f'(-{root})')} + {rest} WHEN {low} IS NOT NULL THEN 1 - {low} ELSE {high} END"),
        ],
    ]


def pearson3_steps(y: str, m: str, s: str, g: str, name: str, fold: Callable[[int, str, str], str] = spark_fold) -> Steps:
    """Columns {name}_cdf, {name}_sf and {name}_pdf at y of the Pearson-III law with mean m, sd s > 0 and skew g."""
    a, x = f"{name}_a", f"{name}_x"
    small, z = f"abs({g}) < {num(1e-6)}", f"(({y} - {m}) / {s})"
    shape = f"4 / greatest({g} * {g}, {num(1e-12)})"
    gamma = gamma_steps(a, x, name, fold)
    density = f"CASE WHEN {x} > 0 THEN exp(({a} - 1) * ln({name}_v) - {name}_v - {ln_gamma(a)}) * 2 / ({s} * abs({g})) ELSE {num(0.0)} END"
    return [
        [(a, shape), (x, f"CASE WHEN {small} THEN {num(1.0)} ELSE {shape} + 2 * {z} / {g} END")],
        *gamma,
        [
            (f"{name}_cdf", f"CASE WHEN {small} THEN {norm_cdf(z)} WHEN {g} > 0 THEN {name}_p ELSE {name}_q END"),
            (f"{name}_sf", f"CASE WHEN {small} THEN {norm_cdf(f'(-{z})')} WHEN {g} > 0 THEN {name}_q ELSE {name}_p END"),
            (f"{name}_pdf", f"CASE WHEN {small} THEN exp(-{z} * {z} / 2) / ({s} * {num(2.5066282746310002)}) ELSE {density} END"),
        ],
    ]


def pearson3_factor_steps(p: str, g: str, name: str, fold: Callable[[int, str, str], str] = spark_fold, rounds: int = 3) -> Steps:
    """Column {name}: the exact Pearson-III frequency factor at non-exceedance p and skew g.

    Newton's steps on the distribution function from Wilson and Hilferty's factor; below a skew of 0.02 the series in the skew.
    """
    z, k = f"{name}_z", f"({g} / 6)"
    near = f"({z} + ({z} * {z} - 1) * {k} + (power({z}, 3) - 6 * {z}) * {k} * {k} / 3 - ({z} * {z} - 1) * power({k}, 3) + {z} * power({k}, 4))"
    wilson = f"2 / {g} * (power(greatest(1 + {g} * {z} / 6 - {g} * {g} / 36, {num(1e-3)}), 3) - 1)"
    series = f"abs({g}) < {num(0.02)}"
    out: Steps = [[(z, norm_ppf(p)), (f"{name}_m", num(0.0)), (f"{name}_s", num(1.0))], [(f"{name}_0", f"CASE WHEN {series} THEN {near} ELSE {wilson} END")]]
    for r in range(rounds):
        at = f"{name}_{r}"
        out += pearson3_steps(at, f"{name}_m", f"{name}_s", g, at + "x", fold)
        # The step uses the smaller tail, and is held within one standard deviation.
        step = f"(CASE WHEN {p} < {num(0.5)} THEN {at}x_cdf - {p} ELSE (1 - {p}) - {at}x_sf END) / greatest({at}x_pdf, {num(1e-300)})"
        out.append([(f"{name}_{r + 1}", f"CASE WHEN {series} THEN {at} ELSE {at} - greatest(-1, least(1, {step})) END")])
    return [*out, [(name, f"{name}_{rounds}")]]


def staged_sql(source: str, steps: Steps) -> str:
    """A subquery of source (a table or a subquery in brackets) with the columns of all steps."""
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step)} FROM {source})"
    return source


def student_steps(t: str, df: str, name: str, fold: Callable[[int, str, str], str] = spark_fold) -> Steps:
    """Column {name}: Student's two-sided tail for any df > 0. From df = 20 on Hill's expansion to a normal deviate, below it the
    incomplete beta function by its continued fraction of fixed length."""
    w, b, u, x, h, g = (f"{name}_{k}" for k in "wbuxhg")
    # The coefficients of Hill's expansion.
    inner = f"((((-{num(0.4)} * {w} - {num(3.3)}) * {w} - 24) * {w} - {num(85.5)}) / ({num(0.8)} * {w} * {w} + 100 + {b}) + {w} + 3) / {b}"

    def beta(x: str, p: str, q: str) -> str:
        m = "floor(k / 2)"
        odd = f"-({p} + {m}) * ({p} + {q} + {m}) * {x} / (({p} + k - 1) * ({p} + k))"
        even = f"{m} * ({q} - {m}) * {x} / (({p} + k - 1) * ({p} + k))"
        out = fold(60, num(1.0), f"1 + (CASE WHEN k % 2 = 1 THEN {odd} ELSE {even} END) / s")
        return f"(exp({p} * ln(greatest({x}, {num(1e-300)})) + {q} * ln(greatest(1 - {x}, {num(1e-300)})) + {g}) / ({p} * {out}))"

    half = num(0.5)
    near = f"CASE WHEN {x} < ({h} + 1) / ({h} + {num(2.5)}) THEN {beta(x, h, half)} ELSE 1 - {beta(f'(1 - {x})', half, h)} END"
    return [
        [(w, f"({df} - {half}) * ln(1 + {t} * {t} / {df})"), (b, f"48 * ({df} - {half}) * ({df} - {half})"), (x, f"{df} / ({df} + {t} * {t})"), (h, f"{df} / 2")],
        [(u, f"-(({inner} + 1) * sqrt({w}))"), (g, f"{ln_gamma(f'({h} + {half})')} - {ln_gamma(h)} - {num(0.5723649429247001)}")],
        [(name, f"CASE WHEN {t} = 0 THEN {num(1.0)} WHEN {df} >= 20 THEN 2 * {norm_cdf(u)} ELSE {near} END")],
    ]
