"""Language identification by a bidirectional gated recurrent network over the bytes of texts.

The network reads a text's bytes from both ends, across words, and labels every byte with probabilities; a text's probabilities are
the mean over its letters' bytes. Long texts are read in pieces that overlap, so that at every byte that counts both states have
seen ``CONTEXT`` bytes, or all there are, on their side. Pieces begin and end between characters.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from hoplens.llm import words

UNKNOWN = "und"
#: Units of each direction.
UNITS = 12
#: Bytes of a piece that count, and those that are read on either side of it for the states' sake.
PIECE, CONTEXT = 512, 64
#: Pieces that are read at a time.
TOGETHER = 512
#: Bounds of the training sample: rows for each language, characters of each row.
TRAIN_ROWS, TRAIN_CHARS = 200, 4000
#: Windows of a training step, their bytes, and the steps.
TRAIN_BATCH, TRAIN_LENGTH, TRAIN_STEPS, TRAIN_RATE = 128, 96, 500, 0.01

#: Bytes of letters, as far as a byte tells: all beyond ASCII count.
LETTER = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)], np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _border(text: bytes, at: int) -> int:
    """The last place up to ``at`` that is no place inside a character."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def pieces_of(text: bytes) -> list[tuple[int, int, int, int]]:
    """Where each piece is read from, counts from, counts to and is read to."""
    cuts = [*(_border(text, at) for at in range(0, len(text), PIECE)), len(text)]
    return [
        (_border(text, max(0, first - CONTEXT)), first, last, _border(text, min(len(text), last + CONTEXT)))
        for first, last in zip(cuts, cuts[1:])
        if first < last
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights: for each direction those of a byte (256, 3 units), of the state (units, 3 units) and of the state's part of
    the candidate; and the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], units: int, rng: np.random.Generator) -> "Network":
        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        weights = {"out": draw(2 * units, len(languages)), "bias": np.zeros(len(languages), np.float32)}
        for side in ("ahead", "back"):
            weights |= {f"{side}_byte": draw(256, 3 * units) * 8, f"{side}_state": draw(units, 3 * units)}
        return cls(languages, weights)

    def _pass(self, side: str, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States of one direction after each byte of equally long words: (bytes, words, units)."""
        byte, state = self.weights[f"{side}_byte"], self.weights[f"{side}_state"]
        units = state.shape[0]
        number, length = codes.shape
        states = np.empty((length, number, units), np.float32)
        h = np.zeros((number, units), np.float32)
        for t in range(length) if side == "ahead" else range(length - 1, -1, -1):
            x = byte[codes[:, t]]
            s = h @ state
            gates = _sigmoid(x[:, : 2 * units] + s[:, : 2 * units])
            z, r = gates[:, :units], gates[:, units:]
            candidate = np.tanh(x[:, 2 * units :] + r * s[:, 2 * units :])
            if trace is not None:
                trace.append((t, h, z, r, candidate, s[:, 2 * units :]))
            h = candidate + z * (h - candidate)
            states[t] = h
        return states

    def _step_weights(self, side: str) -> tuple[np.ndarray, np.ndarray]:
        """The weights for ``_advance``: those of the gates halved, as a gate is a hyperbolic tangent of half its input."""
        halved = np.ones(3 * self.weights[f"{side}_state"].shape[0], np.float32)
        halved[: len(halved) // 3 * 2] = 0.5
        return self.weights[f"{side}_byte"] * halved, np.ascontiguousarray((self.weights[f"{side}_state"] * halved).T)

    def sweep(self, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Places of sequences, from the last on, with the probabilities of each language there: (languages, sequences).

        ``codes`` is (places, sequences); sequences end at their lengths, and what is given behind that means nothing.
        """
        places, number = codes.shape
        units = self.weights["ahead_state"].shape[0]
        out = np.ascontiguousarray(self.weights["out"].T)
        bias = self.weights["bias"][:, None]
        pulled, gates = np.empty((3 * units, number), np.float32), np.empty((2 * units, number), np.float32)
        candidate, taken = np.empty((units, number), np.float32), np.empty((number, 3 * units), np.float32)

        def advance(h: np.ndarray, at: int, byte: np.ndarray, state: np.ndarray) -> None:
            x = np.take(byte, codes[at].astype(np.intp), axis=0, out=taken).T
            np.matmul(state, h, out=pulled)
            np.add(x[: 2 * units], pulled[: 2 * units], out=gates)
            np.tanh(gates, out=gates)
            np.multiply(gates, 0.5, out=gates)
            np.add(gates, 0.5, out=gates)
            np.multiply(gates[units:], pulled[2 * units :], out=candidate)
            np.add(candidate, x[2 * units :], out=candidate)
            np.tanh(candidate, out=candidate)
            np.subtract(h, candidate, out=h)
            np.multiply(h, gates[:units], out=h)
            np.add(h, candidate, out=h)

        ahead = np.empty((places, units, number), np.float32)
        h = np.zeros((units, number), np.float32)
        weights = self._step_weights("ahead")
        for at in range(places):
            advance(h, at, *weights)
            ahead[at] = h
        h = np.zeros((units, number), np.float32)
        weights, shortest = self._step_weights("back"), lengths.min(initial=places)
        for at in range(places - 1, -1, -1):
            advance(h, at, *weights)
            if at >= shortest:
                h *= lengths > at  # behind a sequence's end the state stays as it begins
            found = out[:, :units] @ ahead[at]
            found += out[:, units:] @ h
            found += bias
            np.subtract(found, found.max(0), out=found)
            np.exp(found, out=found)
            np.divide(found, found.sum(0), out=found)
            yield at, found

    def label_bytes(self, text: bytes) -> np.ndarray:
        """The probabilities of each language at every byte of a text: (bytes, languages)."""
        held = np.empty((len(text), len(self.languages)), np.float32)
        for start, first, last, end in pieces_of(text):
            codes = np.frombuffer(text[start:end].translate(words.LOWER), np.uint8)[:, None]
            for at, found in self.sweep(codes, np.array([end - start])):
                if first <= start + at < last:
                    held[start + at] = found[:, 0]
        return held

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes and its gradients, by backpropagation through time."""
        traces: dict[str, list] = {"ahead": [], "back": []}
        sides = [self._pass(side, codes, traces[side]) for side in traces]
        states = np.concatenate(sides, 2)
        p = _softmax(states @ self.weights["out"] + self.weights["bias"])
        number, length = codes.shape
        rows = np.arange(number)
        loss = -np.log(np.maximum(p[:, rows, labels], 1e-9)).mean()
        error = p
        error[:, rows, labels] -= 1
        error /= number * length
        flat = states.reshape(-1, states.shape[2])
        grads = {"out": flat.T @ error.reshape(-1, error.shape[2]), "bias": error.sum((0, 1))}
        into = error @ self.weights["out"].T
        units = into.shape[2] // 2
        for k, side in enumerate(traces):
            state = self.weights[f"{side}_state"]
            d_byte, d_state = np.zeros_like(self.weights[f"{side}_byte"]), np.zeros_like(state)
            carried = np.zeros((number, units), np.float32)
            into_bytes = np.empty((length, number, 3 * units), np.float32)
            for t, h, z, r, candidate, pulled in reversed(traces[side]):
                d = into[t, :, k * units : (k + 1) * units] + carried
                d_candidate = d * (1 - z) * (1 - candidate**2)
                d_z = d * (h - candidate) * z * (1 - z)
                d_r = d_candidate * pulled * r * (1 - r)
                d_s = np.concatenate([d_z, d_r, d_candidate * r], 1)
                into_bytes[t] = np.concatenate([d_z, d_r, d_candidate], 1)
                d_state += h.T @ d_s
                carried = d * z + d_s @ state.T
            order = np.argsort(codes.T, axis=None, kind="stable")
            sorted_codes = codes.T.reshape(-1)[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))
            d_byte[sorted_codes[first]] = np.add.reduceat(into_bytes.reshape(-1, into_bytes.shape[2])[order], first)
            grads[f"{side}_byte"], grads[f"{side}_state"] = d_byte, d_state
        return float(loss), grads


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(2, keepdims=True, initial=-np.inf))
    return x / x.sum(2, keepdims=True)


def fit(samples: list[tuple[str, str]], units: int = UNITS, steps: int = TRAIN_STEPS, seed: int = 0) -> Network:
    """Train on (text, language) samples, with Adam, on windows of bytes drawn evenly from the languages.

    Of each language all texts are one run of bytes, with a line end between two; windows begin between characters, and go across words.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({language for _, language in samples})
    network = Network.fresh(languages, units, rng)
    runs, begins = [], []
    for language in languages:
        run = "\n".join(text for text, own in samples if own == language and has_letter(text)).encode().translate(words.LOWER)
        run = np.frombuffer(run * (TRAIN_LENGTH // max(1, len(run)) + 1), np.uint8) if run else np.zeros(TRAIN_LENGTH, np.uint8)
        runs.append(run)
        begins.append(np.flatnonzero((run & 0xC0) != 0x80))
    if len(languages) < 2:
        return network
    starts = [begin[begin <= len(run) - TRAIN_LENGTH] if len(run) > TRAIN_LENGTH else begin[:1] for run, begin in zip(runs, begins, strict=True)]
    mean = {k: np.zeros_like(w) for k, w in network.weights.items()}
    square = {k: np.zeros_like(w) for k, w in network.weights.items()}
    span = np.arange(TRAIN_LENGTH)
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(languages), TRAIN_BATCH)
        codes = np.stack([runs[k][starts[k][rng.integers(len(starts[k]))] + span] for k in labels])
        _, grads = network.gradients(codes, labels)
        rate = TRAIN_RATE * (1 - step / (steps + 1))
        for k, g in grads.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            scale = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            network.weights[k] -= (rate * scale * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return network


def pool(network: Network, texts: list[bytes]) -> np.ndarray:
    """Each text's mean probabilities over its letters' bytes: (texts, languages).

    Pieces are read by their lengths, ``TOGETHER`` of them at a time, so memory does not grow with texts. Equal texts are read once.
    """
    place = {text: i for i, text in enumerate(dict.fromkeys(texts))}
    pieces = sorted(
        ((end - start, i, start, first, last, end, text) for text, i in place.items() for start, first, last, end in pieces_of(text)),
        key=lambda piece: piece[:3],
    )
    total, size = np.zeros((len(place), len(network.languages))), np.zeros(len(place))
    for k in range(0, len(pieces), TOGETHER):
        part = pieces[k : k + TOGETHER]
        lengths = np.array([length for length, *_ in part])
        longest = int(lengths.max())
        raw = b"".join(text[start:end].ljust(longest, b"\0") for _, _, start, _, _, end, text in part).translate(words.LOWER)
        codes = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(len(part), longest).T)
        at = np.arange(longest)[:, None]
        counts = (at >= np.array([first - start for _, _, start, first, *_ in part])) & (
            at < np.array([last - start for _, _, start, _, last, *_ in part])
        )
        weight = LETTER[codes] * counts
        sums = np.zeros((len(network.languages), len(part)))
        for place_at, found in network.sweep(codes, lengths):
            sums += found * weight[place_at]
        owners = np.array([i for _, i, *_ in part])
        np.add.at(total, owners, sums.T)
        np.add.at(size, owners, weight.sum(0))
    return (total / np.maximum(size, 1)[:, None])[[place[text] for text in texts]]


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows that training never sees; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, may_train: Column, language: str = "lang") -> Network:
    """A network from a bounded sample of labelled rows, TRAIN_ROWS for each language by a hash of ``doc_id`` and text.

    Of a long text a window at a place by hash is taken. The driver sees the sample alone, however often rows repeat.
    """
    labelled = docs.where(may_train & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col(language).isNotNull())
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS + 1)) + 1
    rows = labelled.select(
        F.col(language).alias("lang"),
        F.substring("text", start.cast("int"), F.lit(TRAIN_CHARS)).alias("text"),
        F.xxhash64("doc_id").alias("mixed"),
        "doc_id",
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mixed", "doc_id", "text"))
    picked = rows.withColumn("rank", rank).where(F.col("rank") <= TRAIN_ROWS).collect()
    return fit([(row.text, row.lang) for row in sorted(picked, key=lambda row: (row.lang, row["rank"]))])


def _labels(network: Network, texts: list[bytes]) -> tuple[list[str], list[float]]:
    known = np.array([has_letter(text.decode()) for text in texts], bool) & bool(network.languages)
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    at = np.flatnonzero(known)
    pooled = pool(network, [texts[i] for i in at]) if len(at) else np.zeros((0, 1))
    for i, row in zip(at.tolist(), pooled, strict=True):
        best = int(row.argmax())
        names[i], scores[i] = network.languages[best], float(min(1.0, row[best]))
    return names, scores


def identify(docs: DataFrame, network: Network, also: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``also``, ``lang_pred`` and ``score`` of every row.

    The score is the language's mean probability over all bytes of letters. A text that is null or has no letter is UNKNOWN with
    the score 0, and so is every text where no language was learnt. Only texts are read; repeated rows are labelled each.
    """
    rows = docs.select("doc_id", *(value.alias(name) for name, value in (also or {}).items()), "text")
    schema = T.StructType(
        [
            *(f for f in rows.schema.fields if f.name != "text"),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    held = docs.sparkSession.sparkContext.broadcast(network)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.sliced(batch):
                names, scores = _labels(held.value, texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names
                )

    return rows.mapInArrow(words.frugal(label), schema)


def in_known_languages(docs: DataFrame, network: Network, least_score: float) -> DataFrame:
    """The rows whose text is in a language that was learnt, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.sliced(batch):
                names, scores = _labels(held.value, texts)
                stays = [name != UNKNOWN and score >= least_score for name, score in zip(names, scores, strict=True)]
                yield part.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(words.frugal(keep), docs.schema)
