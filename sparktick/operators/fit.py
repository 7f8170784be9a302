"""Maximum likelihood for all (symbol, window, day, restart) at once: constrained, accelerated EM for many keys in parallel.

A key's events are those of `w_h` days of one symbol. One step (`advance`) takes the sums of an EM step at the present parameters to
the next parameters; where the sums come from is another matter: for keys of at most MOST_EVENTS events from numpy in tasks that
iterate restarts of one key, for larger ones from one decayed scan and aggregation over the events of all of them,
with the parameters as a small table that is checkpointed after every step.

The M-step keeps the spectral radius rho of A = alpha / beta at or below RHO_MOST exactly. In logarithms of A it is a convex
program: maximise sum(kids log A - A G), subject to log A_ud + log A_du <= log(r - A_uu) + log(r - A_dd). Its multiplier is found
by bisection, and each entry follows from it in closed form. Steps are extrapolated in logarithms (squared extrapolation); an
extrapolation that lowers the likelihood is taken back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktick.functions.keyed import uniform
from sparktick.operators.excitation import ALPHA, BETA, FIT, MU, PAIRS, branching_matrix, statistics
from sparktick.session import cut_lineage, materialise

# Parameter bounds, largest spectral radius, start grid and start shares.
LOW, HIGH, BETA_LOW = 1e-8, 1e3, 1e-4
RHO_MOST = 0.99
BETA_GRID = (0.1, 0.5, 1.0, 2.0)
ALPHA_SHARE, MU_SHARE, JITTER = 0.2, 0.5, 0.2

KEY = [*FIT, "restart"]
PARAMS = [*MU, *ALPHA, *BETA]
MOST_EVENTS = 500_000  # of a key that one task iterates: about 130 MB of numpy arrays
SHORT_EVENTS = 1_024  # up to which a key's sums are taken by doubling, n log n but few array operations
MOST_TOGETHER = 8  # restarts of a short key that are iterated side by side
GRID_ROWS = 1_024  # of a longer key's grid of events: as many as its columns are worth numpy's cost of an operation
LONG_FIT, TASKS_PER_CORE = 100, 16  # steps from which a fit's restarts are dealt to many tasks, and how many at most
LEAST_EVENTS = len(PARAMS) + 1  # a key with fewer cannot determine its parameters
START, ONWARD, TRIED = 0, 1, 2  # phases of a row: at a base point, one step beyond it, at an extrapolation


def start_values(head: DataFrame, restarts: int, seed: int = 0, beta_grid: Sequence[float] = BETA_GRID) -> DataFrame:
    """`restarts` random starts per theta key, keyed by (seed, day, w_h, restart)."""
    rows = head.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    u = lambda name: uniform("fit", seed, F.col("symbol"), F.col("day"), F.col("w_h"), F.col("restart"), name)
    near = lambda name: 1.0 - JITTER + 2.0 * JITTER * u(name)
    grid = F.array(*[F.lit(float(b)) for b in beta_grid])
    beta = {f"beta_{p}": F.get(grid, F.floor(u(f"beta_{p}") * len(beta_grid)).cast("int")) for p in PAIRS}
    out = rows.withColumns(beta)
    alpha = {f"alpha_{p}": ALPHA_SHARE * F.col(f"beta_{p}") * near(f"alpha_{p}") for p in PAIRS}
    rate = {"mu_u": F.col("n_up") / F.col("total_time"), "mu_d": F.col("n_down") / F.col("total_time")}
    mu = {c: F.greatest(MU_SHARE * rate[c] * near(c), F.lit(1e-6)) for c in MU}
    return out.withColumns(alpha | mu)


# --------------------------------------------------------------------------- one step, from sums to parameters


def radius(a: Sequence[float]) -> float:
    """Spectral radius of the matrix (uu, ud, du, dd)."""
    return 0.5 * (a[0] + a[3] + math.sqrt((a[0] - a[3]) ** 2 + 4.0 * a[1] * a[2]))


def branching_step(kids: Sequence[float], weight: Sequence[float], most: float = RHO_MOST) -> list[float]:
    """Branching ratios that maximise sum(kids log A - A weight) with rho(A) <= most."""
    weight = [max(w, 1e-300) for w in weight]
    free = [k / w for k, w in zip(kids, weight)]
    if radius(free) <= most:
        return free

    def at(share: float) -> list[float]:
        out = [0.0] * 4
        for i in (0, 3):
            b = kids[i] + weight[i] * most + share
            out[i] = 2.0 * kids[i] * most / (b + math.sqrt(max(b * b - 4.0 * weight[i] * kids[i] * most, 0.0)))
        for i in (1, 2):
            out[i] = max(kids[i] - share, 0.0) / weight[i]
        return out

    low, high = 0.0, min(kids[1], kids[2])
    for _ in range(100):
        middle, ends = 0.5 * (low + high), (low, high)
        if radius(at(middle)) > most:
            low = middle
        else:
            high = middle
        if (low, high) == ends:  # neighbours: no later step would change them
            break
    return at(high)


def em_step(value: dict[str, float], sums: dict[str, float]) -> dict[str, float]:
    """Parameters after one EM step from those the sums were taken at."""
    kids, weight = [sums[f"P_{p}"] for p in PAIRS], [sums[f"G_{p}"] for p in PAIRS]
    ratio = branching_step(kids, weight)
    out = {f"mu_{c}": min(max(sums[f"bg_{c}"] / sums["total_time"], LOW), HIGH) for c in "ud"}
    for p, k, a in zip(PAIRS, kids, ratio):
        beta = k / max(sums[f"D_{p}"] + a * sums[f"H_{p}"], 1e-300) if k > 0 else value[f"beta_{p}"]
        out[f"beta_{p}"] = min(max(beta, BETA_LOW), HIGH)
        out[f"alpha_{p}"] = min(max(a * out[f"beta_{p}"], LOW), HIGH)
    return out


def steepness(value: dict[str, float], sums: dict[str, float]) -> float:
    """Largest slope of the likelihood per event in logarithms of mu, A and beta, along directions the bounds leave free."""
    a = [value[f"alpha_{p}"] / value[f"beta_{p}"] for p in PAIRS]
    up = [sums[f"P_{p}"] - x * sums[f"G_{p}"] for p, x in zip(PAIRS, a)]
    if radius(a) >= RHO_MOST * (1.0 - 1e-9):
        pull = [x / max(RHO_MOST - x, 1e-12) if i in (0, 3) else 1.0 for i, x in enumerate(a)]
        share = max(0.0, sum(u * w for u, w in zip(up, pull)) / sum(w * w for w in pull))
        up = [u - share * w for u, w in zip(up, pull)]
    slopes = [0.0 if value[f"alpha_{p}"] <= LOW * (1 + 1e-9) and u < 0 else u for p, u in zip(PAIRS, up)]
    for p, x in zip(PAIRS, a):
        beta = value[f"beta_{p}"]
        g = sums[f"P_{p}"] - beta * (sums[f"D_{p}"] + x * sums[f"H_{p}"])
        slopes.append(0.0 if (beta <= BETA_LOW * (1 + 1e-9) and g < 0) or (beta >= HIGH * (1 - 1e-9) and g > 0) else g)
    for c in "ud":
        g = sums[f"bg_{c}"] - value[f"mu_{c}"] * sums["total_time"]
        slopes.append(0.0 if value[f"mu_{c}"] <= LOW * (1 + 1e-9) and g < 0 else g)
    return max(map(abs, slopes)) / sums["n_events"]


def _logs(value: Sequence[float]) -> list[float]:
    mu, alpha, beta = value[:2], value[2:6], value[6:]
    return [*map(math.log, mu), *[math.log(a / b) for a, b in zip(alpha, beta)], *map(math.log, beta)]


def _within(logs: Sequence[float]) -> list[float]:
    """Parameters of given logarithms, moved into the bounds and below RHO_MOST."""
    within = lambda x, low, high: math.exp(min(max(x, math.log(low)), math.log(high)))
    mu, beta = [within(x, LOW, HIGH) for x in logs[:2]], [within(x, BETA_LOW, HIGH) for x in logs[6:]]
    a = [math.exp(min(max(x, -60.0), 20.0)) for x in logs[2:6]]
    shrink = min(1.0, RHO_MOST / max(radius(a), 1e-300))
    return [*mu, *[min(max(x * shrink * b, LOW), HIGH) for x, b in zip(a, beta)], *beta]


def advance(row: dict, tol: float, accelerate: bool = True) -> dict:
    """The next state of one fit. `row` has PARAMS, the sums at them, phase, `other` (ten parameters) and `best` (a likelihood).

    START: the parameters are a base, the next ones are one EM step on. ONWARD: they are that step; a second one is taken, and the
    three points give an extrapolation. TRIED: they are the extrapolation; if its likelihood is below the last one, the second
    step (`other`) is the new base, otherwise the extrapolation is.
    """
    value = [row[c] for c in PARAMS]
    out = {"slope": steepness(row, row), "phase": START, "other": row["other"], "best": row["best"], "done": False}
    if row["phase"] == TRIED and row["loglik"] < row["best"] - 1e-10 * abs(row["best"]):
        return out | {"next": list(row["other"])}
    if out["slope"] < tol:
        return out | {"done": True, "next": value}
    step = em_step(row, row)
    stepped = [step[c] for c in PARAMS]
    if not accelerate:
        return out | {"next": stepped}
    if row["phase"] != ONWARD:
        return out | {"next": stepped, "phase": ONWARD, "other": value}
    zero, one, two = _logs(row["other"]), _logs(value), _logs(stepped)
    first = [b - a for a, b in zip(zero, one)]
    turn = [c - b - r for b, c, r in zip(one, two, first)]
    size = math.sqrt(sum(v * v for v in turn))
    length = max(1.0, min(math.sqrt(sum(r * r for r in first)) / size, 1e4)) if size > 0 else 1.0
    far = [a + 2.0 * length * r + length * length * v for a, r, v in zip(zero, first, turn)]
    return out | {"next": _within(far), "phase": TRIED, "other": stepped, "best": row["loglik"]}


# --------------------------------------------------------------------------- large keys: one scan and aggregation a step


def em_fit(
    fit_set: DataFrame, head: DataFrame, restarts: int = 5, max_iter: int = 500, tol: float = 1e-6, seed: int = 0,
    starts: DataFrame | None = None, accelerate: bool = True,
) -> DataFrame:
    """All restarts of all theta keys; one row per (key, restart) with loglik, rho, converged, n_iter and slope.

    A row stops once no free slope exceeds `tol` per event; only open rows are iterated, and closed rows join one small table.
    """
    base = materialise(fit_set.select(*FIT, "fit_day", "bar_idx", "t", "k", "g", "horizon"), "fit-events")
    starts = starts if starts is not None else start_values(head, restarts, seed)
    state = {"phase": F.lit(START), "other": F.array(*map(F.lit, [0.0] * len(PARAMS))), "best": F.lit(0.0)}
    open_rows = cut_lineage(starts.select(*KEY, F.col("total_time").cast("double").alias("total_time"), *PARAMS).withColumns(state))
    kinds = {f.name: f.dataType.simpleString() for f in open_rows.schema}
    schema = ", ".join(
        [f"{c} {kinds[c]}" for c in [*KEY, "total_time"]] + [f"{c} double" for c in PARAMS]
        + ["phase int, other array<double>, best double, n_events long, loglik double, converged boolean, n_iter int, slope double, closed boolean"]
    )

    def step(i: int) -> Callable:
        def run(tables):
            for table in tables:
                rows = []
                for row in table.to_dict("records"):
                    new = advance(row, tol, accelerate)
                    closed = new["done"] or i == max_iter - 1
                    held = [row[c] for c in PARAMS] if closed else new["next"]
                    rows.append((*[row[c] for c in [*KEY, "total_time"]], *held, new["phase"], new["other"], new["best"], row["n_events"],
                                 row["loglik"], new["done"], i + 1, new["slope"], closed))
                yield pd.DataFrame(rows, columns=[part.split()[0] for part in schema.split(", ")])
        return run

    finished: list[DataFrame] = []
    for i in range(max_iter):
        stats = statistics(base.join(open_rows.drop("phase", "other", "best"), FIT), [*KEY, "fit_day"], KEY)
        table = cut_lineage(stats.join(open_rows.select(*KEY, "phase", "other", "best"), KEY).mapInPandas(step(i), schema))
        if not table.filter("closed").isEmpty():
            finished.append(table.filter("closed"))
            if len(finished) > 20:  # a bounded number of branches, however many steps
                finished = [cut_lineage(reduce(DataFrame.unionByName, finished))]
        open_rows = table.filter("not closed").select(*KEY, "total_time", *PARAMS, "phase", "other", "best")
        if open_rows.isEmpty():
            break
    out = branching_matrix(reduce(DataFrame.unionByName, finished).drop("phase", "other", "best", "closed"))
    return out.withColumn("loglik_per_event", F.col("loglik") / F.col("n_events"))


# --------------------------------------------------------------------------- small keys: all steps in one task


def _fades(fade: np.ndarray, size: int = 1) -> list[np.ndarray]:
    """Products of the last 1, 2, 4, .. factors at each place, up to the length or until all of them are zero: what doubling needs.
    A place has `size` entries."""
    out, step = [], size
    while step < len(fade) and fade.any():
        out.append(fade)
        fade = np.concatenate([fade[:step], fade[step:] * fade[:-step]])
        step *= 2
    return out


def _decayed(fades: list[np.ndarray], fresh: np.ndarray, size: int = 1) -> np.ndarray:
    """x_i = fade_i x_{i-1} + fresh_i by doubling; `fades` of the factors serve several such sums."""
    x = fresh.copy()
    for i, fade in enumerate(fades):
        step = size << i
        x[step:] += fade[step:] * x[:-step]
    return x


def _along_rows(fade: np.ndarray, fades: list[np.ndarray], x: np.ndarray) -> None:
    """x_i = fade_i x_{i-1} + x_i in place, where each row goes on from the end of the row before; `fades` are those of whole rows.

    All rows run along the columns at once: a first time from nothing, which gives their ends; doubling links these; and a second time
    from the end of the row before.
    """
    end = x[0].copy()
    for now, fresh in zip(fade[1:], x[1:]):
        np.multiply(end, now, out=end)
        np.add(end, fresh, out=end)
    size = len(PAIRS)
    last = np.concatenate([np.zeros(size), _decayed(fades, end, size)[:-size]])
    for now, here in zip(fade, x):
        np.multiply(last, now, out=end)
        np.add(here, end, out=here)
        last = here


class KeySums:
    """The sums of an EM step over the events of a short key, for several parameters side by side."""

    def __init__(self, events: pd.DataFrame):
        events = events.sort_values(["fit_day", "bar_idx"])
        t, g, horizon = (events[c].to_numpy(float) for c in ("t", "g", "horizon"))
        new_day = (events["fit_day"] != events["fit_day"].shift()).to_numpy()
        self.lag = np.where(new_day, 0.0, np.diff(t, prepend=t[0]))
        self.lags, code = np.unique(self.lag, return_inverse=True)  # equal lags fade alike; a new day has no past at all
        self.code = np.where(new_day, len(self.lags), code)
        of = [(events["k"] == m).to_numpy() for m in (0, 1)]
        self.places = [np.flatnonzero(m) for m in of]
        self.weight, rest = [g[i] for i in self.places], horizon - t
        self.rest = [rest[i] for i in self.places]
        before = [np.concatenate([[0.0], (g * m)[:-1]]) for m in of]
        self.before = np.stack([before["ud".index(p[1])] for p in PAIRS], axis=1)
        self.n = len(events)

    def at(self, value: dict[str, float]) -> dict[str, float]:
        return self.at_all([value])[0]

    def at_all(self, values: Sequence[dict[str, float]]) -> list[dict[str, float]]:
        n, many, out = self.n, len(values), {}
        of = lambda names: np.array([[v[c] for v in values] for c in names])
        mu, alpha, beta = of(MU), of(ALPHA), of(BETA)
        table = np.append(np.exp(-beta.reshape(-1, 1) * self.lags), np.zeros((beta.size, 1)), axis=1)
        fade = np.ascontiguousarray(table.T)[self.code]
        fades = _fades(fade)
        sums = _decayed(fades, (fade.reshape(n, -1, many) * self.before[:, :, None]).reshape(n, -1))
        ages = _decayed(fades, self.lag[:, None] * sums)
        rate = np.empty((many, n))
        for m, c in enumerate("ud"):
            place, pairs = self.places[m], slice(2 * m, 2 * m + 2)
            shares, lags = (alpha[pairs, :, None] * np.ascontiguousarray(x.reshape(n, -1, many)[place, pairs].transpose(1, 2, 0)) for x in (sums, ages))
            own = mu[m, :, None] + shares[0] + shares[1]
            rate[:, place] = own
            out[f"bg_{c}"] = (mu[m, :, None] / own).sum(axis=1)
            for i, p in enumerate(PAIRS[pairs]):
                out[f"P_{p}"], out[f"D_{p}"] = (shares[i] / own).sum(axis=1), (lags[i] / own).sum(axis=1)
        out["loglik"] = np.log(rate).sum(axis=1) - (mu[0] + mu[1]) * of(["total_time"])[0]
        for i, p in enumerate(PAIRS):
            source = "ud".index(p[1])
            place, weight, rest = self.places[source], self.weight[source], self.rest[source]
            gone = np.exp(-beta[i, :, None] * rest)
            for name, part in (("G", weight * (1.0 - gone)), ("H", weight * rest * gone)):
                full = np.zeros((many, n))  # summed in the order of all events
                full[:, place] = part
                out[f"{name}_{p}"] = full.sum(axis=1)
            out["loglik"] = out["loglik"] - alpha[i] / beta[i] * out[f"G_{p}"]
        out = {name: x.tolist() for name, x in out.items()}
        return [{"n_events": n, "total_time": v["total_time"]} | {name: x[j] for name, x in out.items()} for j, v in enumerate(values)]


class GridSums:
    """The sums of an EM step over the events of a long key, with work in proportion to the events.

    Events are the places of a grid, row after row, each with its four pairs side by side; see `_along_rows`.
    """

    def __init__(self, events: pd.DataFrame):
        events = events.sort_values(["fit_day", "bar_idx"])
        t, g, horizon = (events[c].to_numpy(float) for c in ("t", "g", "horizon"))
        new_day = (events["fit_day"] != events["fit_day"].shift()).to_numpy()
        lag = np.where(new_day, 0.0, np.diff(t, prepend=t[0]))
        of = [(events["k"] == m).to_numpy() for m in (0, 1)]
        self.n, pairs = len(events), len(PAIRS)
        width = -(-self.n // max(1, min(GRID_ROWS, self.n // 8)))
        rows = -(-self.n // width)

        def grid(values: np.ndarray) -> np.ndarray:
            full = np.zeros((rows * width, pairs), values.dtype)
            full[:self.n] = values
            return np.ascontiguousarray(full.reshape(rows, width, pairs).swapaxes(0, 1)).reshape(width, rows * pairs)

        self.lags, code = np.unique(lag, return_inverse=True)  # equal lags fade alike; a new day has no past at all
        code = np.where(new_day, len(self.lags), code)
        self.code = grid(code[:, None] + np.arange(pairs) * (len(self.lags) + 1))
        self.lag = grid(np.repeat(lag[:, None], pairs, axis=1))
        weight = np.stack([g * of["ud".index(p[1])] for p in PAIRS], axis=1)
        self.before, self.total = grid(np.concatenate([np.zeros((1, pairs)), weight[:-1]])), weight.sum(axis=0)
        at = np.arange(self.n)
        at = (at % width * rows + at // width) * pairs
        places = [np.sort(at[m]) for m in of]  # an order of the sums that reads the grid along memory
        self.part = {"u": slice(len(places[0])), "d": slice(len(places[0]), None)}
        self.places = np.stack([np.concatenate([i + PAIRS.index(c + s) for i, c in zip(places, "ud")]) for s in "ud"])
        last = np.flatnonzero(np.append(new_day[1:], True))
        self.ends, self.rest, self.end_weight = at[last] + np.arange(pairs)[:, None], (horizon - t)[last], weight[last].T
        self.fade, self.sums, self.ages = (np.empty(self.code.shape) for _ in range(3))
        self.picked = [np.empty(self.places.shape) for _ in range(2)]

    def _past(self, beta: np.ndarray) -> None:
        """`sums` and `ages`: decayed sums of the earlier weights and of weights times their age, for each place and pair."""
        table = np.append(np.exp(-beta[:, None] * self.lags), np.zeros((len(PAIRS), 1)), axis=1)
        fade = np.take(table, self.code, out=self.fade, mode="clip")
        fades = _fades(np.multiply.reduce(fade, axis=0), len(PAIRS))
        _along_rows(fade, fades, np.multiply(fade, self.before, out=self.sums))
        _along_rows(fade, fades, np.multiply(self.lag, self.sums, out=self.ages))

    def at(self, value: dict[str, float]) -> dict[str, float]:
        beta = np.array([value[f"beta_{p}"] for p in PAIRS])
        self._past(beta)
        sums, ages = (np.take(v, self.places, out=o, mode="clip") for v, o in zip((self.sums, self.ages), self.picked))
        rate = np.empty(self.n)
        for c, own in self.part.items():
            np.multiply(sums[0, own], value[f"alpha_{c}u"], out=rate[own])
            rate[own] += value[f"alpha_{c}d"] * sums[1, own]
            rate[own] += value[f"mu_{c}"]
        out = {"n_events": self.n, "total_time": value["total_time"]}
        loglik = float(np.log(rate).sum()) - (value["mu_u"] + value["mu_d"]) * value["total_time"]
        inverse = 1.0 / rate
        sums *= inverse
        ages *= inverse
        # What has not faded by a day's horizon: the sums go on from its last event.
        fade, weight = np.exp(-beta[:, None] * self.rest), self.end_weight + self.sums.ravel()[self.ends]
        left, aged = (fade * weight).sum(axis=1), (fade * (self.ages.ravel()[self.ends] + self.rest * weight)).sum(axis=1)
        for c, own in self.part.items():
            out[f"bg_{c}"] = value[f"mu_{c}"] * float(inverse[own].sum())
        for i, p in enumerate(PAIRS):
            source, own = "ud".index(p[1]), self.part[p[0]]
            out[f"P_{p}"], out[f"D_{p}"] = (value[f"alpha_{p}"] * float(v[source, own].sum()) for v in (sums, ages))
            out[f"G_{p}"], out[f"H_{p}"] = float(self.total[i] - left[i]), float(aged[i])
            loglik -= value[f"alpha_{p}"] / value[f"beta_{p}"] * out[f"G_{p}"]
        return out | {"loglik": loglik}

    def at_all(self, values: Sequence[dict[str, float]]) -> list[dict[str, float]]:
        return [self.at(value) for value in values]


def key_sums(events: pd.DataFrame) -> KeySums | GridSums:
    return (KeySums if len(events) <= SHORT_EVENTS else GridSums)(events)


def _in_task(max_iter: int, tol: float, accelerate: bool):
    """Some restarts of one key, side by side; the same steps as `em_fit`."""

    def fit(events: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        kept = [*KEY, "total_time", "n_events", "loglik", "converged", "n_iter", "slope", *PARAMS]
        rows = []
        sums = key_sums(events) if len(events) and len(starts) else None
        open_fits = [start | {"phase": START, "other": [0.0] * len(PARAMS), "best": 0.0} for start in starts.to_dict("records")] if sums else []
        for i in range(max_iter):
            going = []
            for state, found in zip(open_fits, sums.at_all(open_fits) if open_fits else ()):
                state |= found
                new = advance(state, tol, accelerate)
                if new["done"] or i == max_iter - 1:
                    rows.append((*[state[c] for c in [*KEY, "total_time"]], sums.n, state["loglik"], new["done"], i + 1, new["slope"], *[state[c] for c in PARAMS]))
                else:
                    going.append(state | dict(zip(PARAMS, new["next"])) | {c: new[c] for c in ("phase", "other", "best")})
            open_fits = going
        return pd.DataFrame(rows, columns=kept)

    return fit


def em_fit_in_tasks(
    fit_set: DataFrame, head: DataFrame, restarts: int = 5, max_iter: int = 500, tol: float = 1e-6, seed: int = 0,
    starts: DataFrame | None = None, accelerate: bool = True,
) -> DataFrame:
    """`em_fit` with the restarts of a key iterated inside tasks: for keys whose events fit there.

    A long key's restart, or some restarts of a short key, get their own copy of the key's events and a number, and numbers are dealt to
    tasks in turn: every task has as many of them, and a full fit has many more tasks than cores, since restarts take very different
    numbers of steps.
    """
    starts = starts if starts is not None else start_values(head, restarts, seed)
    together = F.greatest(F.lit(1), F.least(F.lit(MOST_TOGETHER), F.floor(4 * SHORT_EVENTS / (F.col("n_up") + F.col("n_down")))))
    starts = starts.withColumn("_part", F.floor(F.col("restart") / together)).select("_part", *KEY, F.col("total_time").cast("double").alias("total_time"), *PARAMS)
    kinds = {f.name: f.dataType.simpleString() for f in starts.schema}
    schema = ", ".join(
        [f"{c} {kinds[c]}" for c in [*KEY, "total_time"]] + ["n_events long, loglik double, converged boolean, n_iter int, slope double"] + [f"{c} double" for c in PARAMS]
    )
    starts = materialise(starts.withColumn("_unit", F.dense_rank().over(Window.orderBy(*FIT, "_part")) - 1), "fit-starts")  # one row a fit: small
    units = starts.select(F.col("_unit").alias("_of"), *[F.col(c).alias(f"_{c}") for c in FIT]).distinct()
    session = head.sparkSession
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))
    if max_iter >= LONG_FIT:
        tasks = max(tasks, TASKS_PER_CORE * session.sparkContext.defaultParallelism)
    tasks = max(1, min(tasks, units.count()))
    rows = fit_set.select(*FIT, "fit_day", "bar_idx", "t", "k", "g", "horizon").join(units, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FIT])
    rows = rows.select("_of", "fit_day", "bar_idx", "t", "k", "g", "horizon").repartitionById(tasks, "_of")
    starts = starts.repartitionById(tasks, "_unit")
    found = rows.groupBy("_of").cogroup(starts.groupBy("_unit")).applyInPandas(_in_task(max_iter, tol, accelerate), schema)
    out = branching_matrix(materialise(found, "fits"))
    return out.withColumn("loglik_per_event", F.col("loglik") / F.col("n_events"))


def em_fit_all(
    fit_set: DataFrame, head: DataFrame, restarts: int, max_iter: int, tol: float, seed: int = 0, most_events: int = MOST_EVENTS,
    starts: DataFrame | None = None, accelerate: bool = True,
) -> DataFrame:
    """Small keys in tasks, the others by steps over all of them."""
    head = head if "_scratch" in head.__dict__ else materialise(head, "fit-keys")
    n = F.col("n_up") + F.col("n_down")
    small, large = head.filter(n <= most_events), head.filter(n > most_events)
    options = {"restarts": restarts, "max_iter": max_iter, "tol": tol, "seed": seed, "accelerate": accelerate}
    if large.isEmpty():
        return em_fit_in_tasks(fit_set, head, starts=starts, **options)
    ours = lambda rows, keys: None if rows is None else rows.join(keys.select(*FIT), FIT, "left_semi")
    out = em_fit_in_tasks(ours(fit_set, small), small, starts=ours(starts, small), **options)
    return out.unionByName(em_fit(ours(fit_set, large), large, starts=ours(starts, large), **options), allowMissingColumns=True)


def best_restart(fits: DataFrame) -> DataFrame:
    """Highest likelihood among the restarts of each theta key (all of them are stationary)."""
    rest = [c for c in fits.columns if c not in FIT]
    best = fits.filter("rho < 1").groupBy(*FIT).agg(F.max_by(F.struct(*rest), F.struct("loglik", "restart")).alias("_best"))
    return best.select(*FIT, "_best.*")


def fit_theta(
    fit_set: DataFrame, head: DataFrame, restarts: int = 5, max_iter: int = 500, tol: float = 1e-6, retry: int = 4,
    least_events: int = LEAST_EVENTS, most_events: int = MOST_EVENTS,
) -> DataFrame:
    """Theta table, one row for every row of `head`, with `reason`: null, "too few events" (no parameters) or "not converged".

    Keys whose best restart has not converged are fitted again with `retry` times as many restarts and steps; the better of both
    fits stays. `usable_theta` and `theta_rejects` split the table.
    """
    head = materialise(head, "fit-head")
    enough = head.filter(F.col("n_up") + F.col("n_down") >= least_events)
    fits = materialise(best_restart(em_fit_all(fit_set, enough, restarts, max_iter, tol, most_events=most_events)), "fits-best")
    open_keys = materialise(enough.join(fits.filter("converged").select(*FIT), FIT, "left_anti"), "fits-open")
    if retry and not open_keys.isEmpty():
        again = em_fit_all(
            fit_set.join(open_keys.select(*FIT), FIT, "left_semi"), open_keys, retry * restarts, retry * max_iter, tol, seed=1, most_events=most_events,
        )
        again = again.withColumn("restart", F.col("restart") + restarts)
        fits = best_restart(fits.unionByName(again.select(*fits.columns)))
    keep = [c for c in head.columns if c not in fits.columns or c in FIT]
    events = (F.col("n_up") + F.col("n_down")).alias("n_events")
    out = head.select(*keep, events, "total_time").join(fits.drop("n_events", "total_time"), FIT, "left")
    why = F.when(F.col("n_events") < least_events, "too few events").when(~F.coalesce("converged", F.lit(False)), "not converged")
    return out.withColumn("reason", why)


def usable_theta(theta: DataFrame) -> DataFrame:
    """Rows with parameters of a reached optimum."""
    return theta.filter("reason is null")


def theta_rejects(wanted: DataFrame, theta: DataFrame) -> DataFrame:
    """Wanted theta keys without a usable fit, and why: also those whose window lacks a kind of event and so have no fit at all."""
    known = theta.select(*FIT, "n_events", "reason", F.lit(True).alias("_known"))
    why = F.when(F.col("_known").isNull(), "one kind of event missing").otherwise(F.col("reason"))
    out = wanted.select(*FIT).distinct().join(known, FIT, "left").withColumn("reason", why)
    return out.filter("reason is not null").select(*FIT, "n_events", "reason")


def few_steps(fit_set: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """Theta after a few plain EM steps from given parameters: `start` has the columns of a head and PARAMS; loglik, A, rho are added."""
    start = materialise(start, "fit-start")
    fits = em_fit_all(fit_set, start, 1, steps + 1, -1.0, starts=start.withColumn("restart", F.lit(0)), accelerate=False)
    found = fits.select(*FIT, *PARAMS, "loglik", "loglik_per_event", "rho", *[f"A_{p}" for p in PAIRS])
    return start.drop(*PARAMS).join(found, FIT)
