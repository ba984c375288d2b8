"""JSON-lines commands, environment dimensions, experiment files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMAND = "job_id string, cmd string, env_name string, max_steps int, seeds array<int>, candidates array<string>, env_spec struct<n_action_dims:int,action_low:double,action_high:double,max_steps:int,success_threshold:double>"
CONFIG = "bits_per_dim double, depth double, max_coeff double, feature_types array<string>, tridiag_max_coeff double, tridiag_dims array<int>, n_episodes int, max_iters int, cegar_rounds int, max_steps int, verifier string, proposer string, scorer string, run_seed int"
EXPERIMENT = f"env_key string, env_name string, config struct<{', '.join(x.strip().replace(' ', ':', 1) for x in CONFIG.split(','))}>"


def commands(lines: DataFrame, column: str = "value") -> DataFrame:
    """A row per line that is not blank: the command's fields, and error for what can't be read."""
    text = lines.filter(F.trim(column) != "").select(F.col(column).alias("line"))
    read = text.withColumn("c", F.from_json("line", COMMAND + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    error = F.when(F.col("c._bad").isNotNull(), "malformed JSON").when(F.col("c.cmd").isNull(), "no command")
    return read.select("line", "c.job_id", "c.cmd", "c.env_name", "c.max_steps", "c.seeds", "c.candidates", "c.env_spec", error.alias("error"))


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    return commands(spark.read.text(path))


def experiments(documents: DataFrame, column: str = "value") -> DataFrame:
    """A row per JSON document: env_key, env_name, config (struct), and the config as it stands (text, to be signed)."""
    read = documents.select(F.from_json(column, EXPERIMENT).alias("e"), F.get_json_object(column, "$.config").alias("config_text"))
    return read.select("e.*", "config_text")


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file."""
    return experiments(spark.read.text(path, wholetext=True))


def scrubbed(payload: Column, drop: list[str], defaults: dict[str, str] | None = None) -> Column:
    """A map of texts without some keys and without nulls, over defaults, its keys in order."""
    kept = F.map_filter(payload, lambda k, v: ~k.isin(*drop) & v.isNotNull())
    base = F.create_map(*(F.lit(x) for kv in (defaults or {}).items() for x in kv)) if defaults else None
    # what is given goes before a default of the same key
    both = F.map_concat(kept, F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(kept), k))) if defaults else kept
    return F.map_from_entries(F.array_sort(F.map_entries(both)))


def with_environment(jobs: DataFrame, environments: DataFrame) -> DataFrame:
    """Each job's environment: its own spec before the table's; neither gives an error.

    environments: env_name, n_action_dims, action_low, action_high, max_steps, success_threshold.
    """
    dim = environments.select("env_name", F.struct("n_action_dims", "action_low", "action_high", "max_steps", "success_threshold").alias("known"))
    joined = jobs.join(dim, "env_name", "left")
    pick = [F.coalesce(F.col(f"env_spec.{c}"), F.col(f"known.{c}")).alias(c) for c in ("n_action_dims", "action_low", "action_high", "success_threshold")]
    steps = F.coalesce(F.col("max_steps"), F.col("env_spec.max_steps"), F.col("known.max_steps")).alias("max_steps")
    lacks = F.when(F.col("env_spec").isNull() & F.col("known").isNull(), F.concat(F.lit("unknown environment "), F.col("env_name")))
    return joined.select("job_id", "cmd", "env_name", *pick, steps, F.coalesce(F.col("error"), lacks).alias("error"))


#: Commands by name, for callers that dispatch on a job's cmd.
COMMANDS: dict = {}


def command(name: str):
    def add(f):
        COMMANDS[name] = f
        return f

    return add


def run_command(name: str, *args, **named):
    if name not in COMMANDS:
        raise ValueError(f"unknown command {name}")
    return COMMANDS[name](*args, **named)
