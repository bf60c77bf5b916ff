"""Evolved formulas: expression trees compiled to columns, scored many at a time.

A generation is evaluated in one pass: all formulas become columns of one select, are unpivoted, and ranked within
(formula, split). A rank among all rows inside a formula is taken cell by cell in many tasks.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings
from tidemark.functions.columns import corr, over_zero, rolling_mean, rolling_pct_rank, rolling_std
from tidemark.operators.stats import ranked, spearman


def _rows():
    """Each symbol's events in order."""
    return Window.partitionBy("symbol").orderBy("date", "event_id")


UNARY = {
    "neg": lambda a: -a,
    "abs": F.abs,
    "sign": F.signum,
    "log1p_abs": lambda a: F.signum(a) * F.log1p(F.abs(a)),
    "rank": None,  # among all rows: ranked() in many tasks, not a column
}
BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": over_zero,
    "max": F.greatest,
    "min": F.least,
}
SERIES = {
    "ts_delta5": lambda a: a - F.lag(a, 5).over(_rows()),
    "ts_mean5": lambda a: rolling_mean(a, _rows(), 5),
    "ts_std10": lambda a: rolling_std(a, _rows(), 10),
    "ts_rank10": lambda a: rolling_pct_rank(a, _rows(), 10),
    "ts_z10": lambda a: over_zero(a - rolling_mean(a, _rows(), 10), rolling_std(a, _rows(), 10)),
}
#: Operators whose argument must be a column of its own first: windows don't nest.
WINDOWED = {"rank", *SERIES}


@dataclass(frozen=True)
class Formula:
    """A leaf (a column's name) or an operator with its arguments."""

    op: str
    args: tuple[Formula, ...] = ()

    def __str__(self) -> str:
        return f"{self.op}({', '.join(map(str, self.args))})" if self.args else self.op

    @property
    def size(self) -> int:
        return 1 + sum(a.size for a in self.args)

    @property
    def depth(self) -> int:
        return 1 + max((a.depth for a in self.args), default=0)

    def leaves(self) -> set[str]:
        return set().union(*(a.leaves() for a in self.args)) if self.args else {self.op}

    def nodes(self) -> list[Formula]:
        return [self, *(n for a in self.args for n in a.nodes())]

    def replaced(self, place: int, other: Formula) -> Formula:
        """This tree with its place-th node (in the order of nodes()) replaced."""
        if place == 0:
            return other
        place -= 1
        args = list(self.args)
        for i, a in enumerate(args):
            if place < a.size:
                args[i] = a.replaced(place, other)
                break
            place -= a.size
        return Formula(self.op, tuple(args))


def parse(text: str) -> Formula:
    text = text.strip()
    if not text.endswith(")"):
        return Formula(text)
    op, _, inner = text[:-1].partition("(")
    args, depth, at = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            args.append(inner[at:i])
            at = i + 1
    return Formula(op, tuple(parse(a) for a in [*args, inner[at:]]))


def evaluated(df: DataFrame, formulas: list[Formula], prefix: str = "_g") -> tuple[DataFrame, list[str]]:
    """df with one column for each formula. Equal subtrees are computed once; each level of windows is one select."""
    made: dict[Formula, str] = {}
    levels: dict[int, list[Formula]] = {}

    def level(f: Formula) -> int:
        below = max((level(a) for a in f.args), default=0)
        return below + (f.op in WINDOWED and bool(f.args))

    def note(f: Formula) -> None:
        for a in f.args:
            note(a)
        if f.args and (f.op in WINDOWED) and f not in made:
            made[f] = f"{prefix}w{len(made)}"
            levels.setdefault(level(f), []).append(f)

    for f in formulas:
        note(f)

    def column(f: Formula, top: bool = False) -> Column:
        if f in made and not top:
            return F.col(made[f])
        if not f.args:
            return F.col(f.op).cast("double")
        args = [column(a) for a in f.args]
        return {**UNARY, **BINARY, **SERIES}[f.op](*args)

    out, helpers = df, []
    for k in sorted(levels):
        plain = {f: column(f.args[0]) for f in levels[k]}
        args = {f"{made[f]}_a": c for f, c in plain.items()}
        out = out.withColumns(args)
        out = ranked(out, {made[f]: f"{made[f]}_a" for f in levels[k] if f.op == "rank"}, share=True)
        out = out.withColumns({made[f]: SERIES[f.op](F.col(f"{made[f]}_a")) for f in levels[k] if f.op != "rank"}).drop(*args)
        helpers += [made[f] for f in levels[k]]
    names = [f"{prefix}{i}" for i in range(len(formulas))]
    return out.withColumns({n: column(f) for n, f in zip(names, formulas, strict=True)}).drop(*helpers), names


def scores(df: DataFrame, formulas: list[Formula], targets: list[str]) -> DataFrame:
    """(k, target, ic, n, kinds): rank correlation of the k-th formula with each target."""
    out, names = evaluated(df, formulas)
    values = F.array(*(F.struct(F.lit(i).alias("k"), F.when(~F.isnan(n), F.col(n)).alias("x")) for i, n in enumerate(names)))
    aims = F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets))
    long = out.select(F.explode(values).alias("v"), aims.alias("aims")).select("v.*", F.explode("aims").alias("t")).select("k", "x", "t.*").filter("x IS NOT NULL AND y IS NOT NULL")
    kinds = long.groupBy("k", "target").agg(F.count_distinct("x").alias("kinds"))
    return spearman(long, ["k", "target"], "x", "y").join(kinds, ["k", "target"])


class Breeder:
    """Random trees, crossover and mutation, from a seed."""

    def __init__(self, columns: list[str], s: Settings = SETTINGS):
        self.columns, self.s, self.rng = columns, s, random.Random(s.gp_seed)

    def tree(self, depth: int) -> Formula:
        r = self.rng
        if depth <= 1 or r.random() < 0.25:
            return Formula(r.choice(self.columns))
        kind = r.random()
        if kind < 0.5:
            return Formula(r.choice(sorted(BINARY)), (self.tree(depth - 1), self.tree(depth - 1)))
        return Formula(r.choice(sorted(UNARY if kind < 0.75 else SERIES)), (self.tree(depth - 1),))

    def crossed(self, a: Formula, b: Formula) -> Formula:
        return a.replaced(self.rng.randrange(a.size), self.rng.choice(b.nodes()))

    def mutated(self, a: Formula) -> Formula:
        return a.replaced(self.rng.randrange(a.size), self.tree(2))

    def next_generation(self, ranked: list[tuple[float, Formula]]) -> list[Formula]:
        """Elite of a tenth, then children of tournament winners."""
        r, size = self.rng, len(ranked)
        pick = lambda: max(r.sample(ranked, min(4, size)), key=lambda x: x[0])[1]
        out = [f for _, f in ranked[: max(1, size // 10)]]
        while len(out) < size:
            child = self.crossed(pick(), pick()) if r.random() < 0.7 else self.mutated(pick())
            out.append(child if child.depth <= self.s.gp_max_depth + 2 else self.tree(self.s.gp_max_depth))
        return out


def evolve(panel: DataFrame, target: str, columns: list[str], siblings: list[str] | None = None, s: Settings = SETTINGS, batch: int = 40, least: int = 200) -> DataFrame:
    """Formulas bred on training events, scored once out of sample: formula, train_ic, oos_ic, oos_n, same_sign, confirmed...

    panel: symbol, date, event_id. The search runs on the driver; only scores (a number for each formula) come back to it.
    """
    side = F.col("date") <= F.lit(s.train_end).cast("date")
    kept = ["symbol", "date", "event_id", target, *(siblings or []), *columns]
    rows = panel.select(*dict.fromkeys(kept)).persist()
    train, test = rows.filter(side), rows.filter(~side)
    known: dict[Formula, float] = {}
    ics: dict[Formula, float] = {}

    def assess(formulas: list[Formula]) -> None:
        new = [f for f in dict.fromkeys(formulas) if f not in known]
        for i in range(0, len(new), batch):
            part = new[i : i + batch]
            found = {r.k: r for r in scores(train, part, [target]).collect()}
            for k, f in enumerate(part):
                r = found.get(k)
                ok = r is not None and r.n >= least and r.kinds >= 10 and r.ic is not None and r.ic == r.ic
                known[f] = abs(r.ic) - 0.002 * f.size if ok else float("-inf")
                ics[f] = r.ic if ok else 0.0

    try:
        breeder = Breeder(columns, s)
        population = [breeder.tree(s.gp_max_depth) for _ in range(s.gp_population)]
        assess(population)
        for _ in range(s.gp_generations):
            population = breeder.next_generation(sorted(((known[f], f) for f in population), key=lambda x: (-x[0], str(x[1]))))
            assess(population)
        best = sorted({f for f in known if known[f] > float("-inf")}, key=lambda f: (-known[f], str(f)))[: s.gp_top_keep]
        aims = [target, *(siblings or [])]
        found = {(r.k, r.target): r for r in (scores(test, best, aims).collect() if best else [])}
    finally:
        rows.unpersist()
    out = []
    for k, f in enumerate(best):
        r, sign = found.get((k, target)), 1 if ics[f] > 0 else -1
        ic = None if r is None else r.ic
        agree = [(found[k, t].ic or 0) * sign > 0 for t in siblings or [] if (k, t) in found]
        same = ic is not None and ic * sign > 0
        consistent = not agree or sum(agree) >= len(agree) / 2
        out.append((str(f), float(ics[f]), ic, None if r is None else r.n, same, consistent, f"{sum(agree)}/{len(agree)}", bool(same and consistent and abs(ic) >= 0.02 and abs(ic) >= 0.5 * abs(ics[f]))))
    return panel.sparkSession.createDataFrame(out, "formula string, train_ic double, oos_ic double, oos_n long, same_sign boolean, mt_consistent boolean, mt_agree string, confirmed boolean")


def top_decile(df: DataFrame, formula: str, ic: float, name: str = "chosen") -> DataFrame:
    """df with a flag of the tenth of events that the formula puts highest (lowest where its correlation is negative)."""
    out, (column,) = evaluated(df, [parse(formula)], "_d")
    low, high = (out.agg(F.percentile(column, F.array(F.lit(0.1), F.lit(0.9))).alias("q")).first().q) or (None, None)
    return out.withColumn(name, F.coalesce(F.col(column) >= F.lit(high) if ic >= 0 else F.col(column) <= F.lit(low), F.lit(False))).drop(column)


def review_pack(alphas: DataFrame, panel: DataFrame) -> DataFrame:
    """For each confirmed formula: its leaves, its correlation with each, how its top tenth changes from day to day; approved is always false."""
    rows = []
    for r in alphas.filter("confirmed").limit(SETTINGS.gp_top_keep).collect():
        f = parse(r.formula)
        out, (c,) = evaluated(panel, [f], "_d")
        leaves = sorted(f.leaves())
        high = out.agg(F.percentile(c, 0.9)).first()[0]
        shared = out.agg(*(corr(c, F.col(x).cast("double")).alias(x) for x in leaves[:6])).first().asDict()
        day = out.groupBy("date").agg(F.avg(F.coalesce((F.col(c) > F.lit(high)).cast("double"), F.lit(0.0))).alias("t"))
        churn = day.select(F.abs(F.col("t") - F.lag("t").over(Window.partitionBy(F.lit(0)).orderBy("date"))).alias("d")).agg(F.avg("d")).first()[0]  # one row for each day
        known = {k: round(v, 3) for k, v in shared.items() if v is not None and v == v}
        most = max(map(abs, known.values()), default=None)
        rows.append((r.formula, r.oos_ic, ", ".join(leaves), known, most, bool(most and most > 0.9), churn, "REQUIRED: say why this should predict returns", False))
    schema = "formula string, oos_ic double, raw_factors_used string, factor_correlations map<string,double>, max_factor_redundancy double, likely_rediscovery boolean, top_decile_daily_churn double, economic_rationale string, approved boolean"
    return panel.sparkSession.createDataFrame(rows, schema)
