"""SQL that runs the iterative solvers as recursive queries, an iteration a step: the twins of operators.solvers.

Differences are window functions over lines of voxels. The state of a step is one row per voxel; key names the columns
that tell images (and runs) apart.
"""

from __future__ import annotations

import math
from itertools import combinations

AXES = "xyz"
OTHER = {"x": "y, z", "y": "x, z", "z": "x, y"}


def _next(c: str, axis: str) -> str:
    return f"coalesce(lead({c}) OVER w{axis} - {c}, 0)"


def _previous(c: str, axis: str) -> str:
    return f"(coalesce(lag({c}) OVER w{axis}, 0) - {c})"


def variation(source: str, dims: int, order: int, alpha: tuple, weight: str | float, iterations: int, data: str = "l1", first: str = "backward", mask: str | None = None, key: str = "image_id", name: str = "st") -> str:
    """`st` (or another name), the states it = 0..iterations from source(key, x, y, z, value, and the columns that alpha, weight and mask
    name): u, and v0, v1, v2 for order 2 and more."""
    axes, pairs = AXES[:dims], list(combinations(range(dims), 2))
    tensor, deep, levels = dims + len(pairs), order > 1, max(0, order - 2)
    t = repr(1 / math.sqrt(8 if order == 1 else 20)) + "::DOUBLE"
    windows = "WINDOW " + ", ".join(f"w{a} AS (PARTITION BY {key}, {OTHER[a]} ORDER BY {a})" for a in axes)
    names = ["u", "ub", *(f"p{i}" for i in range(dims))]
    if deep:
        names += [f"{n}{i}" for n in ("v", "vb") for i in range(dims)] + [f"q{k}" for k in range(tensor)]
    for m in range(levels):
        names += [f"{n}{m}_{k}" for n in ("s", "sb", "r") for k in range(tensor)]

    def symmetric(c: str, d) -> list[str]:
        return [d(f"{c}{i}", axes[i]) for i in range(dims)] + [f"({d(f'{c}{i}', axes[j])} + {d(f'{c}{j}', axes[i])}) / 2" for i, j in pairs]

    def own(c: str, d) -> list[str]:
        return [d(f"{c}{i}", axes[i]) for i in range(dims)] + [f"({d(f'{c}{dims + k}', axes[i])} + {d(f'{c}{dims + k}', axes[j])}) / 2" for k, (i, j) in enumerate(pairs)]

    def contracted(c: str) -> list[str]:
        out = [[_next(f"{c}{i}", axes[i])] for i in range(dims)]
        for k, (i, j) in enumerate(pairs):
            out[i].append(_next(f"{c}{dims + k}", axes[j]))
            out[j].append(_next(f"{c}{dims + k}", axes[i]))
        return [" + ".join(x) for x in out]

    # Duals: moved, then projected.
    moved = [f"p{i} + {t} * ({_next('ub', axes[i])}{f' - vb{i}' if deep else ''}) AS tp{i}" for i in range(dims)]
    norms = ["sqrt(" + " + ".join(f"tp{i} * tp{i}" for i in range(dims)) + ") AS lp"]
    new = [f"tp{i} / greatest(1, lp / {alpha[0]}) AS np{i}" for i in range(dims)]
    square = lambda c: "sqrt(" + " + ".join(f"{2 if k >= dims else 1} * {c}{k} * {c}{k}" for k in range(tensor)) + ")"
    if deep:
        over = [f" - sb0_{k}" if levels else "" for k in range(tensor)]
        moved += [f"q{k} + {t} * ({e}{over[k]}) AS tq{k}" for k, e in enumerate(symmetric("vb", _previous))]
        norms.append(f"{square('tq')} AS lq")
        new += [f"tq{k} / greatest(1, lq / {alpha[1]}) AS nq{k}" for k in range(tensor)]
    kinds = []
    for m in range(levels):
        odd = m % 2 == 1 if first == "backward" else m % 2 == 0
        kinds.append((_next, _previous) if odd else (_previous, _next))
        above = [f" - sb{m + 1}_{k}" if m + 1 < levels else "" for k in range(tensor)]
        moved += [f"r{m}_{k} + {t} * ({e}{above[k]}) AS tr{m}_{k}" for k, e in enumerate(own(f"sb{m}_", kinds[m][0]))]
        norms.append(f"{square(f'tr{m}_')} AS lr{m}")
        new += [f"tr{m}_{k} / greatest(1, lr{m} / {alpha[m + 2]}) AS nr{m}_{k}" for k in range(tensor)]
    # Primal fields from the new duals.
    primal = [f"u - {t} * ({' + '.join(_previous(f'np{i}', axes[i]) for i in range(dims))}) AS mu"]
    if deep:
        primal += [f"v{i} - {t} * ({e} - np{i}) AS nv{i}" for i, e in enumerate(contracted("nq"))]
    for m in range(levels):
        below = "nq" if m == 0 else f"nr{m - 1}_"
        primal += [f"s{m}_{k} - {t} * ({e} - {below}{k}) AS ns{m}_{k}" for k, e in enumerate(own(f"nr{m}_", kinds[m][1]))]
    step = f"{t} * {weight}"
    nu = f"(mu + {step} * f) / (1 + {step})" if data == "l2" else f"CASE WHEN mu - f > {step} THEN mu - {step} WHEN mu - f < -({step}) THEN mu + {step} ELSE f END"
    values = {"u": "nu", "ub": "2 * nu - u"} | {f"p{i}": f"np{i}" for i in range(dims)}
    if deep:
        values |= {f"v{i}": f"nv{i}" for i in range(dims)} | {f"vb{i}": f"2 * nv{i} - v{i}" for i in range(dims)} | {f"q{k}": f"nq{k}" for k in range(tensor)}
    for m in range(levels):
        values |= {f"s{m}_{k}": f"ns{m}_{k}" for k in range(tensor)} | {f"sb{m}_{k}": f"2 * ns{m}_{k} - s{m}_{k}" for k in range(tensor)} | {f"r{m}_{k}": f"nr{m}_{k}" for k in range(tensor)}
    inside = (lambda n: f"CASE WHEN {mask} >= 1 THEN {values[n]} ELSE {n} END") if mask else (lambda n: values[n])
    extra = ", ".join(c for c in dict.fromkeys([*(str(a) for a in alpha), str(weight), mask or ""]) if c.isidentifier())
    kept = f"{key}, x, y, z, f{', ' + extra if extra else ''}"
    start = ", ".join(["value AS u", "value AS ub", *(f"0.0::DOUBLE AS {n}" for n in names[2:])])
    return f"""{name} AS (
  SELECT 0 AS it, {kept.replace(', f', ', value AS f', 1)}, {start} FROM {source}
  UNION ALL
  SELECT it + 1, {kept}, {', '.join(inside(n) for n in names)}
  FROM (SELECT *, {nu} AS nu FROM (SELECT *, {', '.join(primal)} FROM (SELECT *, {', '.join(new)} FROM (SELECT *, {', '.join(norms)} FROM (
    SELECT *, {', '.join(moved)} FROM {name} WHERE it < {iterations} {windows}))) {windows})))"""


def integrated(source: str, width: int | str, height: int | str, key: str = "image_id", name: str = "shading", extra: str = "") -> str:
    """`shading`(key, x, y, value), the zero-mean image of a flat source(key, x, y, z, v0, v1) whose gradient is nearest to v.
    width and height may be scalar queries."""
    line = f"WINDOW wx AS (PARTITION BY {key}, y ORDER BY x), wy AS (PARTITION BY {key}, x ORDER BY y)"
    return f"""{name}_f AS MATERIALIZED (SELECT {key}, x, y, {_previous('v0', 'x')} + {_previous('v1', 'y')} AS value FROM {source} {extra} {line}),
{name}_a AS MATERIALIZED (SELECT {key}, a.k AS x, y, sum(value * cos(pi() * (x + 0.5) * a.k / {width})) AS value FROM {name}_f CROSS JOIN (SELECT unnest(range({width})) AS k) AS a GROUP BY {key}, a.k, y),
{name}_b AS MATERIALIZED (SELECT {key}, x, b.k AS y, sum(value * cos(pi() * (y + 0.5) * b.k / {height})) AS value FROM {name}_a CROSS JOIN (SELECT unnest(range({height})) AS k) AS b GROUP BY {key}, x, b.k),
{name}_c AS MATERIALIZED (SELECT {key}, x, y, CASE WHEN x = 0 AND y = 0 THEN 0 ELSE value / (4 - 2 * cos(pi() * x / {width}) - 2 * cos(pi() * y / {height})) END AS value FROM {name}_b),
{name}_d AS MATERIALIZED (SELECT {key}, a.k AS x, y, sum(value * CASE WHEN x = 0 THEN 1 ELSE 2 * cos(pi() * (a.k + 0.5) * x / {width}) END) / {width} AS value FROM {name}_c CROSS JOIN (SELECT unnest(range({width})) AS k) AS a GROUP BY {key}, a.k, y),
{name} AS MATERIALIZED (SELECT {key}, CAST(x AS INTEGER) AS x, CAST(b.k AS INTEGER) AS y, sum(value * CASE WHEN y = 0 THEN 1 ELSE 2 * cos(pi() * (b.k + 0.5) * y / {height}) END) / {height} AS value FROM {name}_d CROSS JOIN (SELECT unnest(range({height})) AS k) AS b GROUP BY {key}, x, b.k)"""


def poisson_cg(source: str, steps: int, eps: float) -> str:
    """`cg`, conjugate gradients for minus the Laplacian of source(image_id, x, y, z, value), one step a row set."""
    windows = "WINDOW " + ", ".join(f"w{a} AS (PARTITION BY image_id, {OTHER[a]} ORDER BY {a})" for a in AXES) + ", image AS (PARTITION BY image_id)"
    ap = " + ".join(f"coalesce(p - {f}(p) OVER w{a}, 0)" for a in AXES for f in ("lag", "lead"))
    return f"""cg AS (
  SELECT 0 AS it, image_id, x, y, z, 0.0::DOUBLE AS u, value AS r, value AS p, sum(value * value) OVER (PARTITION BY image_id) AS rr0, sum(value * value) OVER (PARTITION BY image_id) AS rr FROM {source}
  UNION ALL
  SELECT it + 1, image_id, x, y, z, nu, nr, nr + CASE WHEN rr > 0 THEN new / rr ELSE 0 END * p, rr0, new
  FROM (SELECT *, sum(nr * nr) OVER (PARTITION BY image_id) AS new
        FROM (SELECT *, u + a * p AS nu, r - a * ap AS nr
              FROM (SELECT *, CASE WHEN rr0 >= {eps} AND rr >= {eps} * rr0 AND rr > 0 THEN coalesce(rr / nullif(sum(p * ap) OVER (PARTITION BY image_id), 0), 0) ELSE 0 END AS a
                    FROM (SELECT *, {ap} AS ap FROM cg WHERE it < {steps} {windows})))))"""


def grown(source: str, seeds: tuple[tuple, ...]) -> str:
    """`g1`, `g2`, ...: for each seed (segment, x, y, z, tolerance) what it reaches face by face in source(image_id, x, y,
    z, value) through voxels that no seed before has."""
    out = []
    for i, (_, x, y, z, tolerance) in enumerate(seeds, 1):
        taken = " AND ".join([f"v.value < {tolerance}", *(f"NOT EXISTS (SELECT 1 FROM g{j} o WHERE o.image_id = v.image_id AND o.x = v.x AND o.y = v.y AND o.z = v.z)" for j in range(1, i))])
        out.append(f"""free{i} AS MATERIALIZED (SELECT image_id, x, y, z FROM {source} v WHERE {taken}),
g{i} AS (
  SELECT image_id, x, y, z FROM {source} WHERE x = {x} AND y = {y} AND z = {z}
  UNION
  SELECT v.image_id, v.x, v.y, v.z FROM g{i} g JOIN free{i} v ON v.image_id = g.image_id AND abs(v.x - g.x) + abs(v.y - g.y) + abs(v.z - g.z) = 1)""")
    return ",\n".join(out)


def resampled(source: str, out: str, width: int, height: int, weight: str, low: int, high: int, new_width: int, new_height: int, at: str = "o * n / m::DOUBLE") -> str:
    """`out`(image_id, x, y, value): source, flat, resampled with weight (of the distance d) at taps low..high beside at."""

    def taps(n: int, m: int) -> str:
        place = at.replace("o", "o.o").replace(" n", f" {n}").replace(" m", f" {m}")
        return f"""(SELECT o, i, sum(w) / sum(sum(w)) OVER (PARTITION BY o) AS w FROM (
  SELECT o, greatest(0, least({n - 1}, floor(p) + k)) AS i, {weight} AS w
  FROM (SELECT o.o, {place} AS p, k.k, {place} - floor({place}) - k.k AS d FROM range(0, {m}) AS o(o) CROSS JOIN range({low}, {high + 1}) AS k(k))) GROUP BY o, i)"""

    return f"""{out} AS (SELECT s.image_id, CAST(a.o AS INTEGER) AS x, CAST(b.o AS INTEGER) AS y, sum(s.value * a.w * b.w) AS value
  FROM {source} s JOIN {taps(width, new_width)} a ON a.i = s.x JOIN {taps(height, new_height)} b ON b.i = s.y GROUP BY s.image_id, a.o, b.o)"""


def splined(source: str, out: str, size: tuple[int, int], new: tuple[int, int], key: str = "image_id") -> str:
    """`out`(key, x, y, value): source, flat, of a size, resampled with cubic B-splines; a grid that grows is two wider
    and cropped. The coefficients are sums over the mirrored line with weights that fall by sqrt(3) - 2 a voxel."""
    pad = 2 if new[0] > size[0] or new[1] > size[1] else 0

    def taps(n: int, m: int) -> str:
        period = 2 * n - 2
        return f"""(SELECT o, i, sum(b * h) AS w FROM (
    SELECT o, b, h, CASE WHEN p > {n - 1} THEN {period} - p ELSE p END AS i FROM (
      SELECT o, CASE WHEN abs(d) < 1 THEN 2.0::DOUBLE / 3 - d * d + abs(d) ** 3 / 2 WHEN abs(d) < 2 THEN (2 - abs(d)) ** 3 / 6 ELSE 0 END AS b,
             -6 * z / (1 - z * z) * power(z, abs(j)) AS h, ((c + j) % {period} + {period}) % {period} AS p
      FROM (SELECT o, CAST(floor(o * {n} / {m + pad}::DOUBLE) AS BIGINT) + k AS c, o * {n} / {m + pad}::DOUBLE - floor(o * {n} / {m + pad}::DOUBLE) - k AS d
            FROM range({m}) AS r(o) CROSS JOIN range(-1, 3) AS t(k)) CROSS JOIN range(-60, 61) AS f(j) CROSS JOIN (SELECT sqrt(3) - 2 AS z)))
  GROUP BY o, i)"""

    return f"""{out} AS MATERIALIZED (SELECT {key}, CAST(a.o AS INTEGER) AS x, CAST(b.o AS INTEGER) AS y, sum(s.value * a.w * b.w) AS value
  FROM {source} s JOIN {taps(size[0], new[0])} a ON a.i = s.x JOIN {taps(size[1], new[1])} b ON b.i = s.y GROUP BY {key}, a.o, b.o)"""


def fitted(source: str, seen: str, size: int, nodes: int, order: int, levels: int) -> str:
    """`fit`(image_id, x, y, value) on the flat, square source: splines through seen(image_id, x, y, value), a field a level,
    with the cardinal splines as sums of truncated powers."""
    out, left = [], seen
    for m in range(levels):
        spans = (nodes - order) * 2**m
        u = f"(x * {spans} / {size - 1}::DOUBLE - (c - {order}))"
        powers = " ".join(f"{'+' if j % 2 == 0 else '-'} {math.comb(order + 1, j)} * greatest(0, {u} - {j}) ** {order}" for j in range(order + 2))
        line = f"(SELECT x, c, ({powers}) / {math.factorial(order)} AS w FROM range({size}) AS p(x) CROSS JOIN range({spans + order}) AS q(c))"
        out.append(f"""taps{m} AS MATERIALIZED (SELECT image_id, x, y, value, cx, cy, w, sum(w * w) OVER (PARTITION BY image_id, x, y) AS w2 FROM (
  SELECT s.image_id, s.x, s.y, s.value, a.c AS cx, b.c AS cy, a.w * b.w AS w FROM {left} s JOIN {line} a ON a.x = s.x JOIN {line} b ON b.x = s.y))""")
        out.append(f"lattice{m} AS MATERIALIZED (SELECT image_id, cx, cy, sum(w * w * w * value / w2) / nullif(sum(w * w), 0) AS c FROM taps{m} GROUP BY ALL)")
        out.append(f"""field{m} AS MATERIALIZED (SELECT s.image_id, s.x, s.y, sum(a.w * b.w * coalesce(l.c, 0)) AS value
  FROM {source} s JOIN {line} a ON a.x = s.x JOIN {line} b ON b.x = s.y LEFT JOIN lattice{m} l ON (l.image_id, l.cx, l.cy) = (s.image_id, a.c, b.c) GROUP BY ALL)""")
        out.append(f"left{m} AS MATERIALIZED (SELECT s.image_id, s.x, s.y, s.value - f.value AS value FROM {left} s JOIN field{m} f USING (image_id, x, y))")
        left = f"left{m}"
    fields = " UNION ALL ".join(f"SELECT * FROM field{m}" for m in range(levels))
    return ",\n".join([*out, f"fit AS (SELECT image_id, x, y, sum(value) AS value FROM ({fields}) GROUP BY ALL)"])
