"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled texts.  A text is parsed against it
from left to right into the longest phrases that occur in the sample; the fewer phrases, the closer the
language.  Phrases are normalised by the sample's size: phrases x log2(sample) / length estimates the cross
entropy in bits a character.  All segments of all texts of a batch walk an automaton together.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

#: The bounded sample that the classifier is fitted on: labelled characters of a language at most and of all together,
#: and labelled rows of a language looked at.
SAMPLE_CHARS, SAMPLE_TOTAL = 20_000, 240_000
SAMPLE_ROWS = 96
#: Characters that are parsed as one; a longer text is several such stretches, all of which count.
SEGMENT = 256
_BETWEEN = re.compile(r"[\W\d_]+")


class Automaton:
    """Suffix automaton over small integer symbols, as one table of transitions (state 0: none, 1: start)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        most = 2 * len(symbols) + 3
        table = np.zeros((most, alphabet), np.int32)
        link, length = [0] * most, [0] * most
        size, last = 2, 1
        for s in symbols.tolist():
            cur, size = size, size + 1
            length[cur] = length[last] + 1
            p = last
            while p and not table[p, s]:
                table[p, s] = cur
                p = link[p]
            if not p:
                link[cur] = 1
            else:
                q = int(table[p, s])
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone, size = size, size + 1
                    table[clone] = table[q]
                    length[clone], link[clone] = length[p] + 1, link[q]
                    while p and table[p, s] == q:
                        table[p, s] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = np.ascontiguousarray(table[:size])
        self.bits = float(np.log2(max(2, len(symbols))))

    def phrases(self, grid: np.ndarray) -> np.ndarray:
        """Phrases of each column of a grid of symbols (row t: the t-th symbol of each; -1 after the end)."""
        state = np.ones(grid.shape[1], np.int32)
        count = np.zeros(grid.shape[1], np.int32)
        flat, width = self.next.reshape(-1), self.next.shape[1]
        for row in grid:
            live = row >= 0
            symbol = np.where(live, row, 0)
            to = flat[state * width + symbol]
            broken = live & (to == 0)
            again = flat[width + symbol]  # the next phrase starts with this symbol, or it is one by itself
            count += broken & (state != 1)
            count += broken & (again == 0)
            state = np.where(live, np.where(broken, np.where(again == 0, 1, again), to), state)
        return count + (state != 1)


class Model:
    """Automata by language over one alphabet of the sample's most frequent characters, all others as one."""

    def __init__(self, samples: dict[str, str], alphabet: int = 96):
        every = np.concatenate([self._points(t) for t in samples.values()] or [np.zeros(0, np.uint32)])
        chars, n = np.unique(every, return_counts=True)
        self.chars = np.sort(chars[np.argsort(-n, kind="stable")[: alphabet - 1]])
        self.names = sorted(samples)
        self.automata = [Automaton(self.symbols(samples[k]), len(self.chars) + 1) for k in self.names]

    @staticmethod
    def _points(text: str) -> np.ndarray:
        """Code points of the letters in lower case; what stands between them is one space."""
        return np.frombuffer(_BETWEEN.sub(" ", text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)

    def symbols(self, text: str) -> np.ndarray:
        points = self._points(text)
        if not len(self.chars):
            return np.zeros(len(points), np.int32)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return np.where(self.chars[at] == points, at, len(self.chars)).astype(np.int32)

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits a character of each text (rows) in each language."""
        coded = [self.symbols(t) for t in texts]
        sizes = np.array([len(x) for x in coded])
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
        first = np.append(0, np.cumsum(sizes))[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        n = np.minimum(SEGMENT, np.append(0, np.cumsum(sizes))[owner + 1] - first)
        out = np.full((len(texts), len(self.names)), np.inf)
        order = np.argsort(-n, kind="stable")
        total = np.zeros((len(texts), len(self.names)))
        for a in range(0, len(order), 16384):
            mine = order[a : a + 16384]
            steps = np.arange(int(n[mine[0]]))[:, None]
            grid = np.where(steps < n[mine], flat[np.minimum(first[mine] + steps, len(flat) - 1)], -1)
            for k, automaton in enumerate(self.automata):
                np.add.at(total[:, k], owner[mine], automaton.phrases(grid))
        some = sizes > 0
        out[some] = total[some] * [a.bits for a in self.automata] / sizes[some, None]
        return out


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, chars: int = SAMPLE_CHARS, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL) -> dict[str, str]:
    """Labelled text by language, bounded: whole texts of the rows of least hash, as many as fit, then stretches
    of equal length from the start of texts that are longer than the bound.

    All languages share `total` characters, each at most `chars`; that is room for a segment each of total / SEGMENT
    languages, and only if there are more labels than that do the rarest of them go without a model.
    """
    named = df.filter(F.col(lang_col).isNotNull() & (F.length(text_col) >= 1))
    sizes = named.groupBy(F.col(lang_col).alias("l")).count().orderBy(F.desc("count"), "l").limit(total // SEGMENT).collect()
    if not sizes:
        return {}
    chars = min(chars, total // len(sizes))
    spread = F.pmod(F.xxhash64(F.col(id_col).cast("bigint"), F.lit("sample")), F.lit(1 << 40))
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["l"]), F.lit(int(min(1.0, 2 * rows / r["count"]) * (1 << 40))))))
    few = named.filter(spread < share[F.col(lang_col)]).select(F.col(lang_col).alias("l"), spread.alias("h"), F.col(id_col).cast("bigint").alias("i"), F.substring(F.col(text_col), 1, chars + 1).alias("t"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "t"))
    got = few.withColumn("n", place).filter(F.col("n") <= rows).orderBy("h", "i", "t").collect()
    out: dict[str, list[str]] = {r["l"]: [] for r in sizes}
    held, longer = dict.fromkeys(out, 0), {k: [] for k in out}
    for r in got:
        if len(r["t"]) > chars:
            longer[r["l"]].append(r["t"])
        elif held[r["l"]] + len(r["t"]) <= chars:
            out[r["l"]].append(r["t"])
            held[r["l"]] += len(r["t"]) + 1
    for k, texts in longer.items():
        part = max(SEGMENT, (chars - held[k]) // max(1, len(texts)) - 1)
        for t in texts[: max(0, chars - held[k]) // (part + 1)]:
            out[k].append(t[:part])
        if not out[k] and texts:
            out[k].append(texts[0][:chars])
    return {k: "\n".join(v) for k, v in out.items() if v}


def _predict(samples):
    def run(batches):
        model = Model(samples.value) if samples.value else None
        for batch in batches:
            texts = batch.columns[-1].to_pylist()
            found: list[tuple] = [("und", 0.0)] * len(texts)
            letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            asked = [i for i, x in enumerate(letters) if x and model]
            at = 0
            while at < len(asked):
                to, size = at, 0
                while to < len(asked) and (to == at or size + len(texts[asked[to]]) < 1 << 21):
                    size += len(texts[asked[to]])
                    to += 1
                cost = model.costs([texts[i] for i in asked[at:to]])
                best = cost.argmin(axis=1)
                # the share of two to the power of minus a text's extra bits, over 8 characters
                odds = np.exp2(-8 * (cost - cost.min(axis=1, keepdims=True))).sum(axis=1)
                for i, k, o in zip(asked[at:to], best, odds, strict=True):
                    found[i] = (model.names[k], 1 / float(o))
                at = to
            C.trim()
            yield pa.RecordBatch.from_arrays([*map(C.loose, batch.columns[:-1]), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64()), pa.array(letters, pa.bool_())], [*batch.schema.names[:-1], "lang_pred", "score", "letters"])

    return run


def held_out(id_col: str):
    """Rows that the classifier must not learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", samples: dict[str, str] | None = None) -> DataFrame:
    """One row per row of df: doc_id, held_out, lang_pred, score.

    The samples come from rows whose crc32(id as text) mod 3 is not 1 and whose label is not null, unless
    given.  A prediction sees the text only.  A text that is null or has no letter gets `und` and score 0,
    as does every text if there is nothing to learn from.  A null id is never held out.  Other columns of df
    are ignored.
    """
    spark = df.sparkSession
    C.prepare(spark)
    if samples is None:
        samples = sample(df.filter(~held_out(id_col)), id_col, text_col, lang_col)
    found = _with_predictions(C.rows_of(df, id_col, text_col), samples)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def _with_predictions(rows: DataFrame, samples: dict[str, str]) -> DataFrame:
    """The rows with lang_pred, score and letters (whether it has any) in place of the last column, the text."""
    kinds = C.nullable(StructType(rows.schema.fields[:-1])).add("lang_pred", "string").add("score", "double").add("letters", "boolean")
    return rows.mapInArrow(C.lean_map(_predict(rows.sparkSession.sparkContext.broadcast(samples))), kinds)


def without_rejects(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df without the rows whose language can't be told (texts that are null or have no letter, whatever was learned);
    rows without a label get the predicted one.  An empty table stays empty; columns may have any names."""
    C.prepare(df.sparkSession)
    samples = sample(df.filter(~held_out(id_col)), id_col, text_col, lang_col)
    rows = C.packed(df, text=F.col(text_col).cast("string"))
    found = _with_predictions(rows, samples).filter("letters")
    told = F.coalesce(F.col("row").getField(lang_col), F.when(F.col("lang_pred") != "und", F.col("lang_pred")).cast(df.schema[lang_col].dataType))
    return found.select(*((told if c == lang_col else F.col("row").getField(c)).alias(c) for c in df.columns))
