"""The isolation forest in SQL: the same samples, trees and scores, by recursion over node rows.

Features are not scaled here: a tree splits between the smallest and the largest value of a node, so
a scaled feature is split at the scaled place, and the same rows go left.
"""

from __future__ import annotations

from collections.abc import Sequence

from vigilog.functions import fixed_values as fv
from vigilog.operators.forest import HASH_DIGITS

from .sql import cte, num


def order_key(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, {HASH_DIGITS}))::BIGINT"


def unit(*parts: str) -> str:
    return f"({order_key(*parts)} / {num(float(16**HASH_DIGITS))})"


def _length(n: str) -> str:
    """Mean depth of an unsuccessful search among n rows."""
    return (
        f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE {num(2.0)} * (ln({n} - {num(1.0)})"
        f" + {num(0.5772156649)}) - {num(2.0)} * ({n} - {num(1.0)}) / {n} END"
    )


def forest(
    name: str, table: str, key: Sequence[str], features: Sequence[str], trees: int = fv.SESSION_TREES,
    folds: int = 0, psi: int = fv.TREE_SAMPLE, seed: int = fv.SEED,
) -> None:
    """Expressions ``{name}_nodes`` and ``{name}_scores`` (the rows of ``table`` with ``raw_score``).

    With ``folds``, ``table`` has ``fold``, and a row's score is that of the forest of the other folds."""
    keys = ", ".join(key)
    values = ", ".join(f"coalesce({f}, 0)::DOUBLE" for f in features)
    own = "fold" if folds else "0"
    cte(f"{name}_rows", f"SELECT *, concat_ws('|', {keys}) AS k, [{values}] AS xs, {own} AS forest FROM {table}", table, keep=True)
    train = f"SELECT forest AS f, k, {keys}, xs FROM {name}_rows WHERE label = 0"
    if folds:
        train = f"SELECT CAST(o AS INTEGER) AS f, k, {keys}, xs FROM {name}_rows, range({folds}) t(o) WHERE label = 0 AND o <> forest"
    cte(f"{name}_train", train, f"{name}_rows", keep=True)
    spare = psi + 8 * psi**0.5 + 16
    cte(f"{name}_sizes", f"SELECT f, least({num(1.0)}, {num(spare)} / count(*)) AS share FROM {name}_train GROUP BY f", f"{name}_train", keep=True)

    def jump(after: str) -> str:
        drawn = f"floor(ln(1 - {unit(str(seed), repr('jump'), after, 'k')}) / ln(1 - share))"
        return f"CASE WHEN share = 1 THEN 0 ELSE least({drawn}, {num(float(1 << 40))})::BIGINT END"

    cte(
        f"{name}_hits",
        f"""SELECT f, k, share, {jump("-1")} AS tree FROM {name}_train JOIN {name}_sizes USING (f)
        UNION ALL SELECT f, k, share, tree + 1 + {jump("tree")} FROM {name}_hits WHERE tree < {trees - 1}""",
        f"{name}_train", f"{name}_sizes", keep=True,
    )
    cte(
        f"{name}_sample",
        f"""SELECT f, tree, xs, CAST(ceil(log2(greatest(count(*) OVER (PARTITION BY f, tree), 2))) AS INTEGER) AS most FROM (
          SELECT *, row_number() OVER (PARTITION BY f, tree ORDER BY {unit(str(seed), 'tree', 'k')}, {keys}) AS place
          FROM (SELECT * FROM {name}_hits WHERE tree < {trees}) JOIN {name}_train USING (f, k)) WHERE place <= {psi}""",
        f"{name}_hits", f"{name}_train", keep=True,
    )
    lows = ", ".join(f"min(xs[{j}]) OVER w" for j in range(1, len(features) + 1))
    highs = lows.replace("min(", "max(")

    def split(rows: str) -> str:
        """Rows with size, feature and cut of their node; no feature in a leaf."""
        stats = f"SELECT *, count(*) OVER w AS n, [{lows}] AS lows, [{highs}] AS highs FROM {rows} WINDOW w AS (PARTITION BY f, tree, node)"
        wide = ", ".join(f"highs[{j}] > lows[{j}]" for j in range(1, len(features) + 1))
        varying = f"SELECT *, list_where(range({len(features)}), [{wide}]) AS vary FROM ({stats})"
        at = unit(str(seed), "f", "tree", "node", "'feature'")
        chosen = f"SELECT *, CASE WHEN n > 1 AND depth < most AND len(vary) > 0 THEN vary[1 + CAST(floor({at} * len(vary)) AS INTEGER)] END AS feature FROM ({varying})"
        cut = f"lows[feature + 1] + {unit(str(seed), 'f', 'tree', 'node', repr('cut'))} * (highs[feature + 1] - lows[feature + 1])"
        return f"SELECT *, {cut} AS cut FROM ({chosen})"

    cte(
        f"{name}_grow",
        f"""SELECT f, tree, 0::BIGINT AS node, 0 AS depth, most, xs FROM {name}_sample
        UNION ALL SELECT f, tree, 2 * node + 1 + CAST(xs[feature + 1] > cut AS BIGINT), depth + 1, most, xs
        FROM ({split(f"{name}_grow")}) WHERE feature IS NOT NULL""",
        f"{name}_sample", keep=True,
    )
    cte(
        f"{name}_nodes",
        f"""SELECT f, tree, node, any_value(depth) AS depth, any_value(n) AS size, any_value(feature) AS feature, any_value(cut) AS cut
        FROM ({split(f"{name}_grow")}) GROUP BY f, tree, node""",
        f"{name}_grow", keep=True,
    )
    cte(f"{name}_vectors", f"SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT forest AS f, xs FROM {name}_rows)", f"{name}_rows", keep=True)
    scored(name, f"{name}_vectors", f"{name}_points", trees, psi)
    cte(
        f"{name}_scores",
        f"SELECT r.*, p.raw_score FROM {name}_rows r JOIN {name}_vectors v ON r.forest = v.f AND r.xs = v.xs JOIN {name}_points p USING (id)",
        f"{name}_rows", f"{name}_vectors", f"{name}_points", keep=True,
    )


def scored(name: str, vectors: str, out: str, trees: int, psi: int = fv.TREE_SAMPLE) -> None:
    """Expression ``out``: ``id, raw_score`` of the vectors ``id, f, xs`` under the forest ``name``.

    One join per level, so that no level is held; a row that has reached its leaf stays there."""
    walk = f"SELECT f, id, xs, tree, 0::BIGINT AS node FROM {vectors}, range({trees}) t(tree)"
    for _ in range((psi - 1).bit_length()):
        walk = (
            "SELECT w.f, w.id, w.xs, w.tree, CASE WHEN n.feature IS NULL THEN w.node ELSE 2 * w.node + 1 + CAST(w.xs[n.feature + 1] > n.cut AS BIGINT) END AS node"
            f" FROM ({walk}) w JOIN {name}_nodes n ON w.f = n.f AND w.tree = n.tree AND w.node = n.node"
        )
    cte(
        out,
        f"""SELECT w.id, -pow({num(2.0)}, -(sum(n.depth + {_length('n.size')}) / {trees} / any_value(z.norm))) AS raw_score
        FROM ({walk}) w JOIN {name}_nodes n ON w.f = n.f AND w.tree = n.tree AND w.node = n.node
        JOIN (SELECT f, {_length('max(size)')} AS norm FROM {name}_nodes WHERE node = 0 GROUP BY f) z ON z.f = w.f GROUP BY w.id""",
        vectors, f"{name}_nodes", keep=True,
    )


def importance(
    name: str, key: Sequence[str], features: Sequence[str], trees: int = fv.SESSION_TREES, seed: int = fv.SEED,
    forest: str | None = None, by: str | None = None,
) -> None:
    """Expression ``{name}_importance``: change of the mean score when a feature comes from the next row by hash.

    The forest is that of the same name, if no other is given. ``by`` cuts ``{name}_rows`` into batches."""
    keys = ", ".join(key)
    own = f"{by}, " if by else ""
    order = f"{f'PARTITION BY {by} ' if by else ''}ORDER BY {order_key(str(seed), repr('shuffle'), 'k')}, {keys}"
    cte(
        f"{name}_pairs",
        f"""SELECT {own}xs, coalesce(lead(xs) OVER ({order}), first_value(xs) OVER ({order} ROWS UNBOUNDED PRECEDING)) AS other
        FROM {name}_rows""",
        f"{name}_rows", keep=True,
    )
    replaced = ", ".join(f"CASE WHEN j = {j} THEN other[{j + 1}] ELSE xs[{j + 1}] END" for j in range(len(features)))
    cte(
        f"{name}_copies",
        f"SELECT {own}j, [{replaced}] AS xs, count(*) AS n FROM {name}_pairs, range(-1, {len(features)}) t(j) GROUP BY ALL",
        f"{name}_pairs", keep=True,
    )
    cte(f"{name}_changed", f"SELECT 0 AS f, xs, row_number() OVER () AS id FROM (SELECT DISTINCT xs FROM {name}_copies)", f"{name}_copies", keep=True)
    scored(forest or name, f"{name}_changed", f"{name}_changed_points", trees)
    cte(
        f"{name}_means",
        f"""SELECT {own}j, sum(n * raw_score) / sum(n) AS s FROM {name}_copies JOIN {name}_changed USING (xs)
        JOIN {name}_changed_points USING (id) GROUP BY {own}j""",
        f"{name}_copies", f"{name}_changed", f"{name}_changed_points", keep=True,
    )
    names = ", ".join(f"'{f}'" for f in features)
    all_of = f"PARTITION BY {by}" if by else ""
    cte(
        f"{name}_importance",
        f"""SELECT {own}[{names}][j + 1] AS feature, round(change / (sum(change) OVER ({all_of}) + {num(1e-9)}), 6) AS importance
        FROM (SELECT *, abs(any_value(s) FILTER (j = -1) OVER ({all_of}) - s) AS change FROM {name}_means) WHERE j >= 0""",
        f"{name}_means",
    )
