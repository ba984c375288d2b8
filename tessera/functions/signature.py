"""Content signatures and labels of experiment configurations, raw JSON texts as they were submitted.

A key that is left out counts as its default; a key that is null stays null.  Only what shapes a policy is signed,
then the search strategies, and these only if they are not the usual ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signed keys in their order, with their defaults as JSON.
SHAPE = {"bits_per_dim": "3", "depth": "1", "feature_types": "null", "max_coeff": "5", "tridiag_max_coeff": "2", "tridiag_dims": "null"}
#: The feature types that there are.
FEATURES = ("axis", "diag", "sq_diag", "prod", "tridiag", "sin_axis", "cos_axis", "wavelet_box", "wavelet_ricker")
#: Strategies other than the usual, by key, with what a label says of them.
STRATEGIES = {"verifier": ("ga_qd", "GAQD"), "proposer": ("ga", "GA"), "scorer": ("successor", "SUCC")}


def quoted(text: Column) -> Column:
    """The text as a JSON string."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def _at(config: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.parse_json(config), f"$.{path}", kind)


def _is(config: Column, path: str, kinds: str) -> Column:
    """Whether the value is of such a type (BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, ARRAY, OBJECT)."""
    return F.coalesce(F.schema_of_variant(_at(config, path)).rlike(f"^({kinds})"), F.lit(False))


def _whole(config: Column, path: str) -> Column:
    """A number without its fraction; null for anything else."""
    return F.when(_is(config, path, "BIGINT"), _at(config, path, "bigint")).when(_is(config, path, "DECIMAL|DOUBLE|FLOAT"), _at(config, path, "double").cast("bigint"))


def _features(config: Column) -> Column:
    """The feature types, each once, in order; an unknown one is an error."""
    given = _at(config, "feature_types", "array<string>")
    unknown = F.filter(given, lambda f: f.isNull() | ~f.isin(*FEATURES))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown feature type in config: "), F.to_json(unknown))).cast("array<string>")).otherwise(F.array_sort(F.array_distinct(given)))


def value(config: Column, key: str) -> Column:
    """A signed key's canonical value as JSON."""
    v = _at(config, key)
    plain = F.when(_whole(config, key).isNotNull(), _whole(config, key).cast("string")).when(_is(config, key, "BOOLEAN"), quoted(_at(config, key, "string"))).otherwise(F.to_json(v))
    if key == "feature_types":
        plain = F.when(_is(config, key, "ARRAY"), F.to_json(_features(config))).otherwise(plain)
    if key == "tridiag_dims":
        ends = [_at(config, f"{key}.{k}", "bigint") for k in ("lo", "hi")]
        plain = F.when(_is(config, key, "OBJECT"), F.concat(F.lit("["), ends[0].cast("string"), F.lit(","), ends[1].cast("string"), F.lit("]"))).otherwise(plain)
    return F.when(v.isNull(), F.lit(SHAPE[key])).when(F.is_variant_null(v), F.lit("null")).otherwise(plain)


def run_seed(config: Column) -> Column:
    """The replicate's number: what is no number of at least 0, nor text that starts with one, is 0."""
    text = F.regexp_extract(_at(config, "run_seed", "string"), r"^\+?(\d+)", 1)
    return F.greatest(F.coalesce(F.when(_is(config, "run_seed", "STRING"), F.when(text != "", text.cast("bigint"))).otherwise(_whole(config, "run_seed")), F.lit(0)), F.lit(0).cast("bigint"))


def strategy(config: Column, key: str) -> Column:
    """The strategy's name if it is not the usual one, else null."""
    name = STRATEGIES[key][0]
    return F.when(_is(config, key, "STRING") & (_at(config, key, "string") == name), F.lit(name))


def continuation(config: Column) -> Column:
    """A cycle of actions (rows of numbers) that successor rollouts follow, as JSON; null for none."""
    path = "successor_continuation"
    actions = _at(config, f"{path}.actions", "array<array<double>>")
    hold = F.coalesce(_whole(config, f"{path}.hold"), F.lit(1))
    body = F.concat(F.lit('{"type":"cycle","hold":'), hold.cast("string"), F.lit(',"actions":'), F.replace(F.to_json(actions), F.lit("E"), F.lit("e")), F.lit("}"))
    return F.when((_at(config, f"{path}.type", "string") == "cycle") & (F.size(actions) > 0), body)


def canonical(config: Column) -> Column:
    """The text that is signed: two configurations have the same one if they share a lineage."""
    parts = [F.concat(F.lit(f'"{k}":'), value(config, k)) for k in SHAPE]
    said = lambda key, text: F.concat(F.lit(f'"{key}":'), text)
    parts += [
        said("verifier", quoted(strategy(config, "verifier"))),
        F.when(run_seed(config) != 0, said("run_seed", run_seed(config).cast("string"))),
        said("proposer", quoted(strategy(config, "proposer"))),
        said("scorer", quoted(strategy(config, "scorer"))),
        said("successor_continuation", continuation(config)),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def signature(config: Column) -> Column:
    """The first 16 hexadecimal digits of the canonical text's SHA-256."""
    return F.substring(F.sha2(canonical(config), 256), 1, 16)


def label(config: Column) -> Column:
    """What tells a configuration from others, in short; nulls and what is usual are left out."""
    shown = lambda key: F.when(value(config, key) != "null", F.regexp_replace(value(config, key), '^"|"$', ""))
    items = lambda key, between: F.when(value(config, key) != "null", F.regexp_replace(F.regexp_replace(value(config, key), r'[\[\]"]', ""), ",", between))
    badge = lambda key: F.when(strategy(config, key).isNotNull(), F.lit(STRATEGIES[key][1]))
    return F.concat_ws(
        " · ",
        F.concat(F.lit("b="), shown("bits_per_dim")),
        F.concat(F.lit("d="), shown("depth")),
        F.concat(F.lit("f="), items("feature_types", ",")),
        F.when(value(config, "max_coeff") != SHAPE["max_coeff"], F.concat(F.lit("c="), shown("max_coeff"))),
        F.concat(F.lit("t="), items("tridiag_dims", ":")),
        F.when(run_seed(config) != 0, F.concat(F.lit("r"), run_seed(config).cast("string"))),
        badge("verifier"),
        badge("proposer"),
        badge("scorer"),
    )
