"""Named plans: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.numeric import rounded
from ..session import tune

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; doubles are rounded to six digits like in its SQL."""

    def register(build: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"plan {name} is already registered")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(tune(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        PLANS[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def metric_sql(prefix: str = "", digits: int = 6, only: tuple[str, ...] = ()) -> str:
    """SQL for the confusion rates over columns tp, tn, fp, fn."""
    p = prefix
    pr, rc = f"({p}tp / nullif({p}tp + {p}fp, 0)::DOUBLE)", f"({p}tp / nullif({p}tp + {p}fn, 0)::DOUBLE)"
    sp = f"({p}tn / nullif({p}tn + {p}fp, 0)::DOUBLE)"
    exprs = {
        "precision": pr,
        "recall": rc,
        "false_positive_rate": f"({p}fp / nullif({p}fp + {p}tn, 0)::DOUBLE)",
        "false_reject_rate": f"({p}fn / nullif({p}tp + {p}fn, 0)::DOUBLE)",
        "specificity": sp,
        "f1": f"(2 * {pr} * {rc} / nullif({pr} + {rc}, 0))",
        "balanced_accuracy": f"(({rc} + {sp}) / 2.0)",
    }
    names = only or tuple(exprs)
    return ", ".join(f"round({exprs[n]}, {digits}) AS {p}{n}" for n in names)


def counts_sql(label: str, decision: str, prefix: str = "") -> str:
    cells = {"tp": (1, ""), "tn": (0, "NOT "), "fp": (0, ""), "fn": (1, "NOT ")}
    return ", ".join(
        f"count(*) FILTER (WHERE {label} = {y} AND {neg}({decision})) AS {prefix}{name}"
        for name, (y, neg) in cells.items()
    )
