"""Language identification: family first, then one-versus-one linear support vector machines.

Features are hashed 3- and 4-grams of bytes over the letters of the whole text, so that a
text is scored in a few vector passes. One set of pairwise machines separates families; a
second set, inside each family, separates its languages. Many families are told apart in
steps, by a tree of groups of them, so that the number of pairs grows with their number and
not with its square. All are trained on the driver from a sample of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _arrow_schema, passed_on, slices, typed
from .tokens import by_text

#: Expected documents for each language to learn from, and from which number of all on they are fewer for each (but not under LEAST).
SAMPLE = 500
ROWS = 64 * SAMPLE
LEAST = 32
#: Families up to which all pairs have a machine (of 128 KB), and the groups at each step beyond (about 4 pairs a family).
FLAT = 16
PARTS = 8
#: Score from which a prediction is accepted where documents are filtered.
ACCEPTED = 0.3
#: Hash buckets of the features.
BITS = 15
EPOCHS = 12
GRAIN = 1 << 20
#: Bytes of one text whose features are held at once.
_BLOCK = 1 << 20
UNKNOWN = "und"
FAMILY = {
    code: family
    for family, codes in {
        "germanic": "en de nl da sv no nb nn is af lb fy yi",
        "romance": "fr es it pt ro ca gl oc",
        "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
        "baltic": "lt lv",
        "uralic": "fi et hu",
        "turkic": "tr az kk uz tk",
        "semitic": "ar he mt am",
        "indic": "hi bn mr gu pa ur ne",
        "iranian": "fa ku tg ps",
        "celtic": "ga cy br gd",
    }.items()
    for code in codes.split()
}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature bucket at each place of all texts, and the number of places by text.

    Three spaces stand before each text, as long as the longest gram but one, so that no
    gram holds letters of two texts and a text has the same features beside any others.
    """
    padded = [b"   " + t + b"  " for t in raw]
    return _buckets(b"".join(padded) + b"   "), 2 * np.array([len(r) for r in padded], np.int64)


def _buckets(data: bytes) -> np.ndarray:
    """The two buckets at each place but the last three."""
    folded = _FOLD[np.frombuffer(data, np.uint8)].astype(np.uint32)
    three = folded[:-3] | folded[1:-2] << np.uint32(8) | folded[2:-1] << np.uint32(16)
    four = three | folded[3:] << np.uint32(24)
    return np.stack([((x * np.uint32(c)) >> np.uint32(32 - BITS)).astype(np.int32) for x, c in ((three, 2654435761), (four, 2246822519))], axis=1).reshape(-1)


def feature_blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`features` of all texts, or of one long text block by block."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    if len(raw) != 1 or len(raw[0]) <= _BLOCK:
        yield features(raw)
        return
    data = b"   " + raw[0] + b"     "
    for a in range(0, len(data) - 3, _BLOCK):
        made = _buckets(data[a : a + _BLOCK + 3])
        yield made, np.array([len(made)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Machines:
    """Pairwise linear machines: ``names``, pairs of their indices, and a column of weights for each pair.

    Weights are whole multiples of 1 / ``GRAIN``, so that sums over a text are exact in any order.
    """

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def votes(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best name's index and its confidence for rows of margins; a pair's first name has the positive side."""
        wins = np.zeros((len(margins), len(self.names)))
        sure = np.ones((len(margins), len(self.names)))
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(4 * margins[:, k], -30, 30)))
            wins[:, i] += p
            wins[:, j] += 1 - p
            sure[:, i] = np.minimum(sure[:, i], p)
            sure[:, j] = np.minimum(sure[:, j], 1 - p)
        best = wins.argmax(axis=1)
        return best, sure[np.arange(len(best)), best]


def machines(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Machines:
    """Trained by averaged stochastic subgradients of the hinge loss, in a fixed order."""
    names = sorted(set(labels))
    pairs = list(combinations(range(len(names)), 2))
    weights = np.zeros((1 << BITS, len(pairs)), np.int32)
    which = np.array([names.index(x) for x in labels])
    for k, (i, j) in enumerate(pairs):
        rows = np.flatnonzero((which == i) | (which == j))
        w, total, steps = np.zeros(1 << BITS), np.zeros(1 << BITS), 0
        rng = np.random.default_rng(k)
        balance = {i: len(rows) / 2 / max(1, int((which == i).sum())), j: len(rows) / 2 / max(1, int((which == j).sum()))}
        for epoch in range(EPOCHS):
            for r in rng.permutation(rows):
                at, x = vectors[r]
                y = 1.0 if which[r] == i else -1.0
                if y * (w[at] @ x) < 1:
                    w[at] += balance[which[r]] * y * x * (0.5 / (1 + epoch))
            total += w
            steps += 1
        weights[:, k] = np.rint(total / steps * GRAIN)
    return Machines(names, pairs, weights)


@dataclass
class Model:
    """The family machines, the machines of each family by its name, and those of each group by the name that stands for it among families."""

    families: Machines
    inside: dict[str, Machines]
    groups: dict[str, Machines] = field(default_factory=dict)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[str | None]]:
        """Language, score and family of each text; ``und`` without letters."""
        if not self.families.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
        blocks = list(feature_blocks(texts)) if len(texts) > 1 else None

        def margins(m: Machines, rows: np.ndarray | None = None) -> np.ndarray:
            total, places = np.zeros((len(texts), len(m.pairs)), np.int64), np.zeros(len(texts), np.int64)
            for buckets, sizes in blocks or feature_blocks(texts):
                places += sizes
                if rows is not None and not rows.all():
                    buckets, sizes = buckets[np.repeat(rows, sizes)], np.where(rows, sizes, 0)
                for k in range(len(m.pairs)):
                    total[:, k] += by_text(m.weights[:, k][buckets].astype(np.int64), sizes)
            out = total / GRAIN / np.sqrt(np.maximum(places, 1))[:, None]
            return out if rows is None else out[rows]

        best, sure = self.families.votes(margins(self.families))
        langs, scores, families = [""] * len(texts), sure.copy(), [self.families.names[b] for b in best]
        for name, own in self.groups.items():  # outer before inner
            rows = np.array([f == name for f in families])
            if rows.any():
                for i, p, s in zip(np.flatnonzero(rows).tolist(), *own.votes(margins(own, rows))):
                    families[i] = own.names[p]
                    scores[i] = min(scores[i], s)
        for name, own in self.inside.items():
            rows = np.array([f == name for f in families])
            if rows.any():
                for i, p, s in zip(np.flatnonzero(rows).tolist(), *own.votes(margins(own, rows))):
                    langs[i] = own.names[p]
                    scores[i] *= s
        for i, t in enumerate(texts):
            if not has_letter(t):
                langs[i], scores[i], families[i] = UNKNOWN, 0.0, None
        return langs, [float(s) for s in scores], families


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts over the root of its places; never more than there are buckets."""
    counts = sum(np.bincount(buckets, minlength=1 << BITS) for buckets, _ in feature_blocks([text]))
    at = np.flatnonzero(counts)
    return at, counts[at] / np.sqrt(counts.sum())


def train(texts: list[str], labels: list[str]) -> Model:
    """A model from labelled texts; those without a letter teach nothing."""
    rows = [(t, x) for t, x in zip(texts, labels) if has_letter(t)]
    return fit([vector(t) for t, _ in rows], [x for _, x in rows])


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Model:
    """A model from labelled vectors."""
    families = [FAMILY.get(x, x) for x in labels]
    inside = {}
    for name in sorted(set(families)):
        own = [i for i, f in enumerate(families) if f == name]
        inside[name] = machines([vectors[i] for i in own], [labels[i] for i in own])
    names = sorted(set(families))
    if len(names) <= FLAT:
        return Model(machines(vectors, families), inside)
    means = np.zeros((len(names), 1024))
    which = {name: k for k, name in enumerate(names)}
    for (at, x), f in zip(vectors, families):
        np.add.at(means[which[f]], at % 1024, x / np.linalg.norm(x))
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    mark = "\0"
    while any(name.startswith(mark) for name in names):
        mark += "\0"
    made: dict[str, Machines] = {}
    todo = [(mark, list(range(len(names))))]
    for own, members in todo:
        split = parts(means, members) if len(members) > PARTS else [[k] for k in members]
        stands = {}
        for n, part in enumerate(split):
            name = names[part[0]] if len(part) == 1 else f"{own}{n}"
            stands.update((names[k], name) for k in part)
            if len(part) > 1:
                todo.append((name, part))
        rows_ = [i for i, f in enumerate(families) if f in stands]
        made[own] = machines([vectors[i] for i in rows_], [stands[families[i]] for i in rows_])
    return Model(made.pop(mark), inside, made)


def parts(means: np.ndarray, members: list[int]) -> list[list[int]]:
    """Members in ``PARTS`` groups of near means: the largest is halved, along its main direction, until they are so many."""
    out = [members]
    while len(out) < PARTS:
        own = out.pop(max(range(len(out)), key=lambda k: len(out[k])))
        apart = means[own] - means[own].mean(axis=0)
        main = apart @ (apart.T @ np.linalg.eigh(apart @ apart.T)[1][:, -1])
        order = [own[k] for k in np.argsort(main, kind="stable")]
        out += [sorted(order[: len(own) // 2]), sorted(order[len(own) // 2 :])]
    return out


def held_out(docs: DataFrame, id_col: str):
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(docs[f"`{id_col}`"].cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Train on rows that are not held out and have a language and an id.

    Every language with such a row is learned. About ``sample`` rows of each are taken, all
    if there are fewer, by a hash of the id; beyond ``ROWS`` in all, about so many divided
    by the number of languages, ``LEAST`` at least. The driver gets the sampled rows'
    vectors, never texts: at most 2**``BITS`` counts a row however long its text is.
    """
    own = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"), docs[f"`{lang_col}`"].cast("string").alias("lang"), held_out(docs, id_col).alias("out"))
    own = own.where("NOT out AND id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Model(Machines([], [], np.zeros((1 << BITS, 0), np.int32)), {})
    sample = min(sample, max(LEAST, ROWS // len(counts)))
    places = 1 << 30
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(places, -(-places * sample // r["count"])))))
    taken = own.where(F.pmod(F.xxhash64("id"), F.lit(places)) < F.try_element_at(share, F.col("lang"))).select(F.col("id").cast("string"), "text", "lang")
    rows = taken.mapInArrow(_vectors, "id string, lang string, at binary, counts binary").collect()
    rows.sort(key=lambda r: (r["id"], r["lang"], r["at"], r["counts"]))
    return fit([(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.float64)) for r in rows], [r["lang"] for r in rows])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of texts with a letter."""
    for piece in slices(batches):
        made = [vector(t) if has_letter(t) else None for t in piece.column(1).to_pylist()]
        keep = pa.array([m is not None for m in made])
        at, counts = (pa.array([m[k].astype(kind).tobytes() for m in made if m], pa.binary()) for k, kind in ((0, np.uint16), (1, np.float64)))
        yield pa.RecordBatch.from_arrays([piece.column(0).filter(keep), piece.column(2).filter(keep), at, counts], names=["id", "lang", "at", "counts"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passing: tuple[str, ...] = ()) -> DataFrame:
    """``id, lang_pred, score, family`` of each row, then the ``passing`` columns as they came.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned.
    Repeated rows are each predicted; other columns are ignored; no rows give no rows. A
    row's prediction is the same beside any other rows; a very long text is scored block by
    block. The model is a few weights for each pair of languages, broadcast to the tasks.
    """
    schema = T.StructType(
        [T.StructField(id_col, typed(docs, id_col)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("family", T.StringType())]
        + [T.StructField(f"_passing_{c}", typed(docs, c)) for c in passing]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent, take = passed_on(docs, text_col, passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow_schema(schema)
        for piece in slices(batches):
            langs, scores, families = shared.value.predict([t or "" for t in piece.column(1).to_pylist()])
            out = [piece.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(families, pa.string()), *take(piece, 2)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, arrow)], schema=arrow)

    own = docs.select(docs[f"`{id_col}`"].alias("_id"), docs[f"`{text_col}`"].cast("string").alias("_text"), *sent)
    return own.mapInArrow(run, schema)
