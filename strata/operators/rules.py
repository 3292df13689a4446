"""Predicates over source text that mark methods likely to be deleted, one boolean column per rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.code import body_lines, effective_lines, last_component, matches_any

# Patterns and constants of the rules that are on by default.
DEFAULT_RULES: list[dict] = [
    {"name": "has_todo", "type": "regex", "patterns": [r"#.*\bTODO\b", r"#.*\bFIXME\b", r"#.*\bHACK\b", r"#.*\bXXX\b"], "flags": ["IGNORECASE"]},
    {"name": "has_deprecated", "type": "regex", "patterns": ["@deprecated", "@deprecate", r"warnings\.warn.*[Dd]eprecat", "DeprecationWarning", "FutureWarning", "# *deprecated", "# *DEPRECATED"]},
    {"name": "uses_select", "type": "regex", "patterns": [r"\.select\s*\("]},
    {"name": "uses_loc", "type": "regex", "patterns": [r"\.loc\s*\["]},
    {"name": "uses_assert_warn", "type": "regex", "patterns": [r"[\w\.]*assert_.*warn[\w]*\s*\("]},
    {"name": "deprecated_naming", "type": "regex_function_name", "patterns": [r"\bdeprecated\b", r"\bold[_-]", r"[_-]old\b", r"\blegacy\b", r"\bobsolete\b"], "flags": ["IGNORECASE"]},
    {
        "name": "temporary_naming",
        "type": "regex_function_name",
        "patterns": [r"\btmp[_-]", r"[_-]tmp\b", r"\btemp[_-]", r"[_-]temp\b", r"\bdebug[_-]", r"[_-]debug\b", r"\bhack\b", r"\bfixme\b", r"\bcompat\b", r"\bcompatibility\b", r"\bbackward[_-]?compat(?:ibility)?\b", r"\bbackward[_-]?compatible\b", r"\bback_?compat\b", r"\bretrocompat\b"],
        "flags": ["IGNORECASE"],
    },
    {"name": "short_method", "type": "threshold", "threshold": 3},
    {"name": "empty_method", "type": "trivial_statements", "trivial_statements": ["pass", "...", "return", "return None"]},
    {"name": "uses_both_select_loc", "type": "composite", "operator": "AND", "sub_patterns": [{"pattern": r"\.select\s*\("}, {"pattern": r"\.loc\s*\["}, {"pattern": r"[\w\.]*assert_.*warn[\w]*\s*\("}]},
    {"name": "single_return", "type": "custom", "class": "strata.operators.rules.single_return"},
    {"name": "private_unused", "type": "custom", "class": "strata.operators.rules.private_unused"},
]


@dataclass(frozen=True)
class Rule:
    """A named predicate: `build` makes the column from a frame's code and function_name."""

    name: str
    build: Callable[[Column, Column], Column] = field(compare=False)
    description: str = ""


def single_return(code: Column, name: Column) -> Column:
    lines = body_lines(code)
    return (F.size(lines) == 1) & F.get(lines, F.lit(0)).startswith("return")


def private_unused(code: Column, name: Column) -> Column:
    last = last_component(name)
    return last.startswith("_") & ~last.startswith("__")


_FLAGS = {"IGNORECASE": "ignore_case", "MULTILINE": "multiline", "DOTALL": "dot_all"}


def _flags(spec: dict) -> dict[str, bool]:
    if unknown := {*(spec.get("flags") or [])} - {*_FLAGS}:
        raise ValueError(f"unknown flags: {sorted(unknown)}")
    return {_FLAGS[f]: True for f in spec.get("flags") or []}


def _need(spec: dict, *names: str) -> None:
    if missing := [n for n in names if spec.get(n) is None]:
        raise ValueError(f"rule {spec.get('name')!r} lacks {', '.join(missing)}")


def _regex(spec: dict):
    _need(spec, "patterns")
    return lambda code, name: matches_any(code, spec["patterns"], **_flags(spec))


def _function_name(spec: dict):
    _need(spec, "patterns")
    return lambda code, name: matches_any(last_component(name), spec["patterns"], **_flags(spec))


def _threshold(spec: dict):
    _need(spec, "threshold")
    return lambda code, name: effective_lines(code) <= int(spec["threshold"])


def _trivial(spec: dict):
    _need(spec, "trivial_statements")
    return lambda code, name: F.forall(body_lines(code), lambda x: x.isin(list(spec["trivial_statements"])))


def _composite(spec: dict):
    _need(spec, "operator", "sub_patterns")
    if spec["operator"] not in ("AND", "OR"):
        raise ValueError(f"unknown operator {spec['operator']!r}")

    def build(code: Column, name: Column) -> Column:
        parts = [matches_any(code, [s["pattern"]], **_flags(s)) for s in spec["sub_patterns"]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if spec["operator"] == "AND" else out | p
        return out

    return build


def _custom(spec: dict):
    _need(spec, "class")
    module, _, name = spec["class"].rpartition(".")
    made = getattr(import_module(module), name)
    return made().apply if isinstance(made, type) else made


#: Kinds of rules; others can be added.
KINDS: dict[str, Callable[[dict], Callable[[Column, Column], Column]]] = {"regex": _regex, "regex_function_name": _function_name, "threshold": _threshold, "trivial_statements": _trivial, "composite": _composite, "custom": _custom}


def make_rules(specs: list[dict] | None = None) -> list[Rule]:
    """Rules from their specifications; those with enabled: false are left out."""
    out = []
    for spec in DEFAULT_RULES if specs is None else specs:
        if not spec.get("enabled", True):
            continue
        _need(spec, "name", "type")
        if spec["type"] not in KINDS:
            raise ValueError(f"unknown rule type {spec['type']!r}")
        out.append(Rule(spec["name"], KINDS[spec["type"]](spec), spec.get("description", "")))
    return out


def load_rules(path: str) -> list[Rule]:
    """Rules from a YAML file with a list `rules`."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return make_rules((yaml.safe_load(f) or {}).get("rules") or [])


def select_rules(rules: list[Rule], wanted: str | list[str] | None = None) -> list[Rule]:
    """All rules for None or `all`, else those of a list or comma-separated text; an unknown name is an error."""
    if wanted is None or wanted == "all":
        return rules
    names = [x.strip() for x in wanted.split(",") if x.strip()] if isinstance(wanted, str) else list(wanted)
    if unknown := [n for n in names if n not in {r.name for r in rules}]:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    return [r for r in rules if r.name in names]


def apply_rules(snippets: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds rule_<name> for every rule. A rule without an answer (null code or name) is false."""
    code, name = F.col("code"), F.col("function_name")
    return snippets.withColumns({f"rule_{r.name}": F.coalesce(r.build(code, name), F.lit(False)) for r in (make_rules() if rules is None else rules)})


def deleted_soon(rows: DataFrame, key: str, order: str, deleted: str, revisions: int = 5) -> DataFrame:
    """Adds is_deleted_soon: the method is deleted in one of its next `revisions` rows (not in this one)."""
    from pyspark.sql import Window

    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(1, revisions)
    return rows.withColumn("is_deleted_soon", F.coalesce(F.max(deleted).over(ahead), F.lit(False)))


def evaluate_rules(features: DataFrame, truth: str, rules: list[str]) -> DataFrame:
    """(rule, tp, fp, fn, tn, precision, recall, f1) of rule columns against a boolean; ratios without a denominator are null."""
    long = features.where(F.col(truth).isNotNull()).select(F.col(truth).alias("t"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("p")) for r in rules])).alias("x")).select("t", "x.*")
    p, t = F.col("p"), F.col("t")
    n = long.groupBy("rule").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp"), F.col("fn")
    return n.select("rule", "tp", "fp", "fn", "tn", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classified_rows(features: DataFrame, truth: str, rules: list[str]) -> DataFrame:
    """One row per snippet and rule, with its outcome TP, FP, FN or TN."""
    keep = [c for c in features.columns if c not in rules]
    long = features.select(*keep, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("p")) for r in rules])).alias("x")).select(*keep, "x.*")
    kind = F.when(F.col("p"), F.when(F.col(truth), "TP").otherwise("FP")).otherwise(F.when(F.col(truth), "FN").otherwise("TN"))
    return long.withColumn("outcome", kind).drop("p")
