"""SQL texts for DuckDB that compute what the registered queries compute, written apart from the column functions."""

from __future__ import annotations

from lumenforge.functions.color import D65, KB, KG, KR, REC709_TO_XYZ, REC2020_TO_XYZ, XYZ_TO_REC709, XYZ_TO_REC2020
from lumenforge.functions.transfer import C1, C2, C3, M1, M2


def d(x: float) -> str:
    """A double literal."""
    return f"CAST({x!r} AS DOUBLE)"


def clamp(x: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"LEAST(GREATEST({x}, {d(low)}), {d(high)})"


def pq(x: str) -> str:
    y = f"POWER({clamp(x)}, {d(M1)})"
    return f"POWER(({d(C1)} + {d(C2)} * {y}) / (1 + {d(C3)} * {y}), {d(M2)})"


def light(x: str) -> str:
    e = f"POWER({clamp(x)}, {d(1 / M2)})"
    return f"POWER(GREATEST({e} - {d(C1)}, 0) / ({d(C2)} - {d(C3)} * {e}), {d(1 / M1)})"


def code(x: str, steps: int) -> str:
    return f"CAST(FLOOR({clamp(x)} * {steps} + {d(0.5)}) AS INTEGER)"


def luma(p: str = "") -> str:
    return f"({d(KR)} * {p}r + {d(KG)} * {p}g + {d(KB)} * {p}b)"


def row(m, i: int, p: str = "", names: str = "rgb") -> str:
    return "(" + " + ".join(f"{d(k)} * {p}{n}" for k, n in zip(m[i], names, strict=True)) + ")"


def times(a, b):
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def srgb(x: str) -> str:
    return f"CASE WHEN {clamp(x)} <= {d(0.0031308)} THEN {clamp(x)} * {d(12.92)} ELSE {d(1.055)} * POWER({clamp(x)}, {d(1 / 2.4)}) - {d(0.055)} END"


def srgb_light(x: str) -> str:
    return f"CASE WHEN {clamp(x)} <= {d(0.04045)} THEN {clamp(x)} / {d(12.92)} ELSE POWER(({clamp(x)} + {d(0.055)}) / {d(1.055)}, {d(2.4)}) END"


def r9(x: str, name: str, places: int = 9) -> str:
    return f"ROUND({x}, {places}) AS {name}"


PIXELS = """p AS (SELECT event_id // 200 AS frame_index, event_id % 200 AS pixel_idx, CAST(event_id % 200 % 20 AS DOUBLE) / 20 AS nx,
  CAST(event_id % 200 // 20 AS DOUBLE) / 10 AS ny, value * 20 AS r, value * (1 + user_id % 7) AS g, value * (1 + event_id % 5) AS b FROM events)"""
SIGNAL = f"s AS (SELECT frame_index, pixel_idx, nx, ny, {', '.join(f'{pq(f"{c} / 10000")} AS {c}' for c in 'rgb')} FROM p)"
KEY = "frame_index, pixel_idx"
WITH = f"WITH {PIXELS}"
WITHS = f"WITH {PIXELS}, {SIGNAL}"


def each(of, places: int = 9, names: str = "rgb") -> str:
    return ", ".join(r9(of(c), c, places) for c in names)


def linear_curve(x: str, points) -> str:
    x = clamp(x)
    arms = " ".join(f"WHEN {x} <= {d(b[0])} THEN {d(a[1])} + ({x} - {d(a[0])}) * {d((b[1] - a[1]) / (b[0] - a[0]))}" for a, b in zip(points, points[1:], strict=False))
    return f"CASE {arms} END"


def hermite_curve(x: str, points, m) -> str:
    """Hermite basis functions, segment by segment."""
    x = clamp(x)

    def arm(i: int) -> str:
        (x0, y0), (x1, y1) = points[i], points[i + 1]
        h, t = x1 - x0, f"(({x} - {d(points[i][0])}) / {d(points[i + 1][0] - points[i][0])})"
        return (f"{d(y0)} * (2 * {t} * {t} * {t} - 3 * {t} * {t} + 1) + {d(h * m[i])} * ({t} * {t} * {t} - 2 * {t} * {t} + {t}) "
                f"+ {d(y1)} * (3 * {t} * {t} - 2 * {t} * {t} * {t}) + {d(h * m[i + 1])} * ({t} * {t} * {t} - {t} * {t})")  # fmt: skip

    return clamp("CASE " + " ".join(f"WHEN {x} <= {d(points[i + 1][0])} THEN {arm(i)}" for i in range(len(points) - 1)) + " END")


def lab_of(p: str) -> tuple[str, str, str]:
    f = []
    for i, w in enumerate(D65):
        v = f"({row(REC2020_TO_XYZ, i, p)} / {d(w)})"
        f.append(f"(CASE WHEN {v} > {d(216 / 24389)} THEN CBRT({v}) ELSE {v} * {d(841 / 108)} + {d(4 / 29)} END)")
    return f"(116 * {f[1]} - 16)", f"(500 * ({f[0]} - {f[1]}))", f"(200 * ({f[1]} - {f[2]}))"


COARSE = f"c AS (SELECT frame_index, pixel_idx, {', '.join(f'FLOOR({clamp(c)} * 31 + {d(0.5)}) / 31 AS {c}' for c in 'rgb')} FROM s)"


def fidelity() -> str:
    a, b = lab_of("a_"), lab_of("b_")
    return f"""{WITHS}, {COARSE},
  t AS (SELECT s.frame_index, {clamp(luma('s.'))} AS x, {clamp(luma('c.'))} AS y, {', '.join(f'{light(f"s.{k}")} AS a_{k}, {light(f"c.{k}")} AS b_{k}' for k in 'rgb')}
    FROM s JOIN c USING (frame_index, pixel_idx)),
  m AS (SELECT frame_index, COUNT(*) AS n_pixels, AVG((x - y) * (x - y)) AS mse, AVG(x) AS mx, AVG(y) AS my, COALESCE(VAR_SAMP(x), 0) AS vx,
    COALESCE(VAR_SAMP(y), 0) AS vy, COALESCE(COVAR_SAMP(x, y), 0) AS c, AVG(SQRT({' + '.join(f'POWER({i} - {j}, 2)' for i, j in zip(a, b, strict=True))})) AS delta_e FROM t GROUP BY frame_index),
  f AS (SELECT frame_index, n_pixels, 10 * LOG10(1 / mse) AS psnr_db, {clamp(f"((2 * mx * my + {d(1e-4)}) * (2 * c + {d(9e-4)})) / ((mx * mx + my * my + {d(1e-4)}) * (vx + vy + {d(9e-4)}))")} AS ssim, delta_e FROM m)"""


TO_709 = times(XYZ_TO_REC709, REC2020_TO_XYZ)
TO_2020 = times(XYZ_TO_REC2020, REC709_TO_XYZ)
STATS = f"st AS (SELECT frame_index, MAX(GREATEST({luma()}, 0)) AS peak, AVG(GREATEST({luma()}, 0)) AS average FROM p GROUP BY frame_index)"


# ---- dither, images, hashes, gain ----------------------------------------------------------------------------


def _wrapped(x: str, k: int) -> str:
    """A 64-bit product that wraps."""
    return f"CAST((CAST({x} AS UHUGEINT) * CAST('{k}' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"


def _scrambled(source: str, keep: str) -> str:
    """Columns ``keep`` and z of a relation that has z as UBIGINT, z through SplitMix64's finaliser."""
    a = f"SELECT {keep}, {_wrapped('XOR(z, z >> 30)', 0xBF58476D1CE4E5B9)} AS z FROM ({source}) za"
    b = f"SELECT {keep}, {_wrapped('XOR(z, z >> 27)', 0x94D049BB133111EB)} AS z FROM ({a}) zb"
    return f"SELECT {keep}, XOR(z, z >> 31) AS z FROM ({b}) zc"


def dither() -> str:
    """(pixel_idx, tr, tg, tb): differences of two of six uniform draws each."""
    golden = 0x9E3779B97F4A7C15
    start = _scrambled(f"SELECT pixel_idx, {_wrapped('CAST(pixel_idx AS UBIGINT)', golden)} AS z FROM (SELECT DISTINCT pixel_idx FROM p) i", "pixel_idx")
    drawn = f"SELECT pixel_idx, k, CAST((CAST(z AS UHUGEINT) + CAST({_wrapped('CAST(k AS UBIGINT)', golden)} AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT) AS z FROM ({start}) s, RANGE(1, 7) t(k)"
    uniform = f"SELECT pixel_idx, k, CAST(z >> 11 AS DOUBLE) / 9007199254740992 AS u FROM ({_scrambled(drawn, 'pixel_idx, k')}) d"
    return f"SELECT pixel_idx, {', '.join(f'SUM(CASE k WHEN {2 * i + 1} THEN u WHEN {2 * i + 2} THEN -u ELSE 0 END) AS t{c}' for i, c in enumerate('rgb'))} FROM ({uniform}) u GROUP BY pixel_idx"


def sdr(points, tangents) -> str:
    """8-bit codes of a 100-nit display for a 1,000-nit hint."""
    return f"""{WITHS}, lin AS (SELECT {KEY}, {', '.join(f'{light(c)} AS {c}' for c in 'rgb')} FROM s), y AS (SELECT *, {luma()} AS y FROM lin),
      m AS (SELECT *, {hermite_curve('y * 10', points, tangents)} AS m FROM y), k AS (SELECT {KEY}, {', '.join(f'{c} * CASE WHEN y > 1e-7 THEN m / y ELSE 0 END AS {c}' for c in 'rgb')} FROM m),
      q AS (SELECT {KEY}, {', '.join(f'{row(TO_709, i)} AS {c}' for i, c in enumerate('rgb'))} FROM k), w AS (SELECT *, {luma()} AS y, LEAST(r, g, b) AS lo, GREATEST(r, g, b) AS hi FROM q),
      t AS (SELECT *, LEAST(GREATEST(CASE WHEN lo < 0 THEN CASE WHEN y - lo > 1e-12 THEN -lo / (y - lo) ELSE 1 END ELSE 0 END, CASE WHEN hi > 1 THEN CASE WHEN hi - y > 1e-12 THEN (hi - 1) / (hi - y) ELSE 1 END ELSE 0 END), 1) AS t FROM w),
      g AS (SELECT {KEY}, {', '.join(f'CASE WHEN t <= 0 THEN {c} ELSE {clamp(f"y + (1 - t) * ({c} - y)")} END AS {c}' for c in 'rgb')} FROM t), n AS ({dither()})
      SELECT {KEY}, {', '.join(f'CAST(LEAST(GREATEST(FLOOR(({srgb(c)}) * 255 + t{c} * 0.5 + 0.5), 0), 255) AS INTEGER) AS {c}' for c in 'rgb')} FROM g JOIN n USING (pixel_idx)"""


def hex_le(x: str, size: int) -> str:
    """Little-endian bytes of a whole number, as hex."""
    return "CONCAT(" + ", ".join(f"PRINTF('%02x', ({x} >> {8 * i}) & 255)" for i in range(size)) + ")"


def float_bits(x: str, source: str, keep: str) -> str:
    """``keep`` and the bits of a non-negative value as a single-precision number."""
    a = f"SELECT {keep}, CAST(CAST({x} AS FLOAT) AS DOUBLE) AS f FROM {source}"
    b = f"SELECT *, CASE WHEN f = 0 THEN 0 ELSE CAST(FLOOR(LOG2(f)) AS INTEGER) END AS e0 FROM ({a}) fa"
    c = f"SELECT *, e0 + CASE WHEN f >= POWER(2, e0 + 1) THEN 1 WHEN f < POWER(2, e0) THEN -1 ELSE 0 END AS e FROM ({b}) fb"
    return f"SELECT {keep}, CASE WHEN f = 0 THEN 0 ELSE ((e + 127) << 23) + CAST((f / POWER(2, e) - 1) * 8388608 AS BIGINT) END AS bits FROM ({c}) fc"


def frame_images() -> str:
    pixels = f"SELECT {KEY}, CONCAT({', '.join(hex_le(code(c, 1023), 2) for c in 'rgb')}) AS h FROM s"
    return f"{WITHS}, h AS ({pixels}), b AS (SELECT frame_index, UNHEX(STRING_AGG(h, '' ORDER BY pixel_idx)) AS b FROM h GROUP BY frame_index) SELECT frame_index, CAST(OCTET_LENGTH(b) AS INTEGER) AS n_bytes, SHA256(b) AS sha256 FROM b"


def stream_hashes(streams: int) -> str:
    channels = " UNION ALL ".join(float_bits(c, "p", f"{KEY}, {i} AS channel") for i, c in enumerate("rgb"))
    return f"""{WITH}, v AS ({channels}), h AS (SELECT *, {hex_le('CAST(bits AS BIGINT)', 4)} AS h FROM v),
      f AS (SELECT frame_index, CONCAT({hex_le('frame_index', 8)}, {hex_le('CAST(2 AS BIGINT)', 4)}, HEX(ENCODE('{{}}')), {hex_le('(COUNT(*) // 3)', 8)}, STRING_AGG(h, '' ORDER BY pixel_idx, channel)) AS x FROM h GROUP BY frame_index)
      SELECT CAST(frame_index % {streams} AS VARCHAR) AS stream_id, SHA256(UNHEX(STRING_AGG(x, '' ORDER BY frame_index))) AS sha256 FROM f GROUP BY frame_index % {streams}"""


def gains(c, pixels: str, give: str) -> str:
    """``give`` over g, the gain of each frame of four streams: a recursion over a stream's frames with its window of lumas
    as a list. ``pixels`` are relations of which the last is m (frame_index, r, g, b)."""
    strength, delta = max(c.gaming_strength, c.temporal_strength), min(c.gaming_delta, c.temporal_delta)
    damp = min(max(1 - min(max(strength, 0), 1) * 0.85, 0.05), 1)
    frames = f"""{pixels}, a AS (SELECT frame_index, AVG({luma()}) AS luma FROM m GROUP BY frame_index),
      f AS (SELECT CONCAT('s', frame_index % 4) AS stream_id, frame_index, ROW_NUMBER() OVER (PARTITION BY frame_index % 4 ORDER BY frame_index) AS k, CAST(4 + frame_index % 13 AS DOUBLE) AS ms, luma, frame_index % 11 = 10 AS locked FROM a),
      w AS (SELECT *, LEAST(GREATEST(ms / {d(c.budget_ms)}, 0.5), 3) AS load FROM f),
      q AS (SELECT *, CASE WHEN load <= 1 THEN CAST(1 AS DOUBLE) ELSE LEAST(GREATEST(1 - {d(0.35 * strength)} * (load - 1), {d(0.45)}), 1) END AS ask FROM w)"""
    limited = f"LEAST(GREATEST(LEAST(GREATEST(g.last + (q.ask - g.last) * {d(damp)}, g.last - {d(delta)}), g.last + {d(delta)}), {d(0.35)}), 1)"
    sd = "SQRT(LIST_AVG(LIST_TRANSFORM(seen, lambda x: (x - LIST_AVG(seen)) * (x - LIST_AVG(seen)))))"
    step = f"""SELECT stream_id, frame_index, k, locked, luma, seen, last0, was, CASE WHEN LEN(seen) >= 2 THEN CASE WHEN {sd} < {d(0.015)} THEN last0 + (lim - last0) * (1 - 0.5 * (1 - {sd} / {d(0.015)})) ELSE lim END
        WHEN was IS NOT NULL AND ABS(luma - was) < {d(0.015)} AND ABS(ask - last0) > {d(delta)} THEN last0 + (lim - last0) * 0.5 ELSE lim END AS g
      FROM (SELECT q.*, g.seen, g.last AS last0, g.was, {limited} AS lim FROM g JOIN q ON g.stream_id = q.stream_id AND q.k = g.k + 1) j"""
    return f"""WITH RECURSIVE {frames.removeprefix('WITH ')}, g AS (
      SELECT DISTINCT stream_id, CAST(-1 AS BIGINT) AS frame_index, CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS was, CAST([] AS DOUBLE[]) AS seen, CAST(1 AS DOUBLE) AS gain, TRUE AS locked FROM f
      UNION ALL SELECT stream_id, frame_index, k, CASE WHEN locked THEN last0 ELSE g END, CASE WHEN locked THEN was ELSE luma * g END,
        CASE WHEN locked THEN seen ELSE LIST_APPEND(seen, luma)[-{c.window}:] END, CASE WHEN locked THEN 1 ELSE g END, locked FROM ({step}) n) {give}"""


# ---- ACES ----------------------------------------------------------------------------------------------------


def _spline(s, x: str) -> str:
    """A tone scale by segments: a quadratic in the place within each, straight lines beyond the ends; x is log10 already."""
    arms = [f"WHEN {x} <= {d(s.x0)} THEN {d(s.slopes[0])} * ({x} - {d(s.x0)}) + {d(s.y0)}"]
    for c, a, b in ((s.low, s.x0, s.x1), (s.high, s.x1, s.x2)):
        n = len(c) - 3
        for i in range(n):
            t = f"({n} * ({x} - {d(a)}) / {d(b - a)} - {i})"
            p, q, r = (float(v) for v in c[i : i + 3])
            end = f"{x} < {d(b)}" if i == n - 1 else f"{n} * ({x} - {d(a)}) / {d(b - a)} < {i + 1}"
            arms.append(f"WHEN {end} THEN {t} * {t} * {d(p / 2 - q + r / 2)} + {t} * {d(q - p)} + {d((p + q) / 2)}")
    return f"POWER(10, CASE {' '.join(arms)} ELSE {d(s.slopes[1])} * ({x} - {d(s.x2)}) + {d(s.y2)} END)"


def _log(c: str) -> str:
    return f"LOG10(GREATEST({c}, {d(6.103515625e-5)}))"


class Steps:
    """A chain of projections, each over the one before."""

    def __init__(self, source: str):
        self.sql, self.n = source, 0

    def add(self, keep: str, **cols: str) -> "Steps":
        self.n += 1
        self.sql = f"SELECT {keep}{''.join(f', {x} AS {c}' for c, x in cols.items())} FROM ({self.sql}) st{self.n}"
        return self

    def matrix(self, m) -> "Steps":
        return self.add(KEY, **{c: row(m, i) for i, c in enumerate("rgb")})


def _sweet(aces) -> Steps:
    """AP0 to AP1 ahead of the tone scale: glow, red modifier, desaturation."""
    s = Steps(f"SELECT {KEY}, " + ", ".join(f"{row(aces.REC2020_TO_AP0, i, '', 'xyz')} AS {c}" for i, c in enumerate("rgb")) + f" FROM (SELECT {KEY}, r / 203 AS x, g / 203 AS y, b / 203 AS z FROM p) w")
    s.add("*", sat=f"(GREATEST(r, g, b, {d(1e-10)}) - GREATEST(LEAST(r, g, b), {d(1e-10)})) / GREATEST(r, g, b, {d(1e-2)})", yc=f"(r + g + b + {d(1.75)} * SQRT(GREATEST(b * (b - g) + g * (g - r) + r * (r - b), 0))) / 3")
    s.add("*", x=f"(sat - {d(0.4)}) / {d(0.2)}")
    s.add("*", gain=f"{d(0.05)} * (1 + SIGN(x) * (1 - POWER(GREATEST(1 - ABS(x / 2), 0), 2))) / 2")
    s.add("*", glow=f"CASE WHEN yc <= {d(2 / 3 * 0.08)} THEN gain WHEN yc >= {d(0.16)} THEN 0 ELSE gain * ({d(0.08)} / yc - 0.5) END")
    s.add(f"{KEY}, sat", r="r * (1 + glow)", g="g * (1 + glow)", b="b * (1 + glow)")
    s.add("*", hue="CASE WHEN r = g AND g = b THEN 999 ELSE DEGREES(ATAN2(SQRT(3) * (g - b), 2 * r - g - b)) END")
    s.add("*", k="(hue + 67.5) * 4 / 135", i="FLOOR((hue + 67.5) * 4 / 135)")
    s.add("*", t="k - i")
    s.add("*", f="CASE i WHEN 0 THEN POWER(t, 3) / 6 WHEN 1 THEN (-3 * POWER(t, 3) + 3 * t * t + 3 * t + 1) / 6 WHEN 2 THEN (3 * POWER(t, 3) - 6 * t * t + 4) / 6 WHEN 3 THEN POWER(1 - t, 3) / 6 ELSE 0 END * 1.5")
    s.add(KEY, r=f"GREATEST(r + CASE WHEN hue > -67.5 AND hue < 67.5 THEN f ELSE 0 END * sat * ({d(0.03)} - r) * {d(0.18)}, 0)", g="GREATEST(g, 0)", b="GREATEST(b, 0)")
    s.add(KEY, **{c: clamp(row(aces.AP0_TO_AP1, i), 0.0, 65504.0) for i, c in enumerate("rgb")})
    return s.matrix(_grey(aces.AP1_Y, 0.96))


def _grey(weights, amount: float):
    return [[(1 - amount) * weights[j] + (amount if i == j else 0) for j in range(3)] for i in range(3)]


def aces_rec709(aces) -> str:
    s = _sweet(aces)
    s.add(KEY, **{c: _spline(aces.RRT, _log(c)) for c in "rgb"}).matrix(aces.AP1_TO_AP0).matrix(aces.AP0_TO_AP1)
    s.add(KEY, **{c: f"({_spline(aces.ODT_48, _log(c))} - {d(0.02)}) / {d(48.0 - 0.02)}" for c in "rgb"}).matrix(aces.AP1_TO_XYZ)
    s.add("*", cx=f"r / GREATEST(r + g + b, {d(1e-10)})", cy=f"g / GREATEST(r + g + b, {d(1e-10)})", yy=f"POWER(GREATEST(g, 0), {d(0.9811)})")
    s.add(KEY, r=f"cx * yy / GREATEST(cy, {d(1e-10)})", g="yy", b=f"(1 - cx - cy) * yy / GREATEST(cy, {d(1e-10)})")
    for m in (aces.XYZ_TO_AP1, _grey(aces.AP1_Y, 0.93), aces.AP1_TO_XYZ, aces.D60_TO_D65, aces.XYZ_TO_709):
        s.matrix(m)
    return f"{WITH} SELECT {KEY}, {each(lambda c: f'POWER({clamp(c)}, {d(1 / 2.4)})')} FROM ({s.sql}) o"


def aces_rec2020(aces, peak: float) -> str:
    import math

    plain = aces.hdr_spline(peak)
    tone = aces.hdr_spline(peak, math.log2(plain.inverse(15.0)) - math.log2(0.18))
    s = _sweet(aces).add(KEY, **{c: f"({_spline(tone, _log(c))} - {d(1e-4)}) / {d(peak - 1e-4)}" for c in "rgb"}).matrix(aces.AP1_TO_XYZ)
    s.add(KEY, **{c: clamp(row(aces.XYZ_TO_2020, i)) for i, c in enumerate("rgb")}).matrix(aces.R2020_TO_XYZ).matrix(aces.D60_TO_D65)
    s.add(KEY, **{c: f"GREATEST({row(aces.XYZ_TO_2020, i)}, 0) * {d(peak)} / 10000" for i, c in enumerate("rgb")})
    return f"{WITH} SELECT {KEY}, {each(pq)} FROM ({s.sql}) o"
