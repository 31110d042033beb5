"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes, whatever they are, forwards and backwards, and labels every position with
probabilities of all languages; a text's probabilities are the mean over the positions of its letters. Texts are cut
into windows of fixed length only so that many can be read side by side: a window also reads MARGIN bytes before and
behind the stretch that it labels. The network is trained in numpy, by backpropagation through time, on stretches from all over
a bounded sample of labelled texts.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, words

#: The sample: distinct labelled texts of each language (those whose hashes are lowest), and stretches drawn from each whole text.
TRAIN_TEXTS, STRETCHES, STRETCH = 300, 8, 64
HIDDEN, EMBEDDED, STEPS, BATCH, RATE, SEED = 12, 12, 450, 64, 0.012, 11
#: Bytes of a window that are labelled, and bytes read on either side of them.
CORE, MARGIN = 308, 12
_AT_ONCE = 1024
UNDETERMINED = "und"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes of letters, as far as a byte tells: ASCII letters and all parts of longer characters.
_LETTER_BYTE = np.array([97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in range(256)])
_HAS_LETTER = r"\p{L}"


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Parameters by name: for each direction ``d`` the input table ``e`` times ``wd``, ``ud`` and ``bd``; the output ``o``, ``c``."""

    def __init__(self, languages: list[str], seed: int = SEED):
        self.languages = languages
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, len(languages)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": rng.standard_normal((256, EMBEDDED)).astype(np.float32) * 0.3, "o": draw(2 * h, n), "c": np.zeros(n, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(EMBEDDED, 3 * h), f"u{d}": draw(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}

    def _run(self, x: np.ndarray, d: str):
        """States after each position in reading order, and what backpropagation needs."""
        h, p = HIDDEN, self.p
        table = p["e"] @ p[f"w{d}"] + p[f"b{d}"]
        state, states, kept = np.zeros((len(x), h), np.float32), [], []
        for t in range(x.shape[1]):
            a, u = table[x[:, t]], state @ p[f"u{d}"]
            zr = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            kept.append((state, z, r, new, u[:, 2 * h :]))
            state = z * state + (1 - z) * new
            states.append(state)
        return states, kept

    def forward(self, x: np.ndarray):
        """Probabilities (rows, positions, languages) for rows of bytes of one length."""
        forward, backward = self._run(x, "f"), self._run(x[:, ::-1], "b")
        both = np.concatenate([np.stack(forward[0], 1), np.stack(backward[0][::-1], 1)], 2)
        logits = both @ self.p["o"] + self.p["c"]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(2, keepdims=True), both, forward[1], backward[1]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy over all positions and its gradients."""
        h, p = HIDDEN, self.p
        prob, both, *kept = self.forward(x)
        n = prob.shape[0] * prob.shape[1]
        loss = float(-np.log(prob[np.arange(len(x)), :, y] + 1e-12).mean())
        out = prob.copy()
        out[np.arange(len(x)), :, y] -= 1
        out /= n
        g = {"o": both.reshape(n, -1).T @ out.reshape(n, -1), "c": out.sum((0, 1)), "e": np.zeros_like(p["e"])}
        back = out @ p["o"].T
        for d, steps, part, xs in (("f", kept[0], back[:, :, :h], x), ("b", kept[1], back[:, ::-1, h:], x[:, ::-1])):
            w, u = p[f"w{d}"], p[f"u{d}"]
            given = np.empty((x.shape[1], len(x), 3 * h), p["e"].dtype)
            gu, carry = np.zeros_like(u), np.zeros((len(x), h), p["e"].dtype)
            for t in range(x.shape[1] - 1, -1, -1):
                state, z, r, new, inner = steps[t]
                ds = part[:, t] + carry
                dn = ds * (1 - z) * (1 - new * new)
                dz = ds * (state - new) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                given[t, :, :h], given[t, :, h : 2 * h], given[t, :, 2 * h :] = dz, dr, dn
                du = np.concatenate([dz, dr, dn * r], 1)
                gu += state.T @ du
                carry = ds * z + du @ u.T
            of_byte = np.eye(256, dtype=p["e"].dtype)[xs.T.ravel()]
            table = of_byte.T @ given.reshape(-1, 3 * h)
            g |= {f"w{d}": p["e"].T @ table, f"u{d}": gu, f"b{d}": table.sum(0)}
            g["e"] += table @ w.T
        return loss, g

    def train(self, found: list[tuple[int, bytes]], steps: int = STEPS, seed: int = SEED) -> None:
        """Adam over random batches of stretches (number of the language, bytes), all languages alike."""
        rng = np.random.default_rng(seed)
        x = np.frombuffer(b"".join(s for _, s in found), np.uint8).reshape(len(found), -1)
        y = np.array([n for n, _ in found])
        weight = 1 / np.bincount(y)[y]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            at = rng.choice(len(x), BATCH, p=weight / weight.sum())
            _, g = self.gradients(x[at], y[at])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """States (position, row, unit) after each labelled position, for bytes (position, row) in reading order.

        The sigmoid of v is (tanh(v / 2) + 1) / 2; the halves are put into the tables. Gates have arrays of their own.
        """
        h, n = HIDDEN, x.shape[1]
        table = self.p["e"] @ self.p[f"w{d}"] + self.p[f"b{d}"]
        split = lambda m, *by: [np.ascontiguousarray(part * b, np.float32) for part, b in zip(np.split(m, 3, axis=1), by, strict=True)]
        of_z, of_r, of_new = split(table, 0.5, 0.5, 1)
        own_z, own_r, own_new = split(self.p[f"u{d}"], 0.5, 0.5, 0.5)
        out = np.empty((CORE, n, h), np.float32)
        state, spare = np.zeros((n, h), np.float32), np.empty((n, h), np.float32)
        z, r, new, u = (np.empty((n, h), np.float32) for _ in range(4))
        for t in range(len(x) - MARGIN):
            at = x[t]
            np.take(of_z, at, 0, z, "clip")
            z += np.matmul(state, own_z, out=u)
            np.tanh(z, out=z)
            np.take(of_r, at, 0, r, "clip")
            r += np.matmul(state, own_r, out=u)
            np.tanh(r, out=r)
            r += 1
            r *= np.matmul(state, own_new, out=u)
            np.take(of_new, at, 0, new, "clip")
            new += r
            np.tanh(new, out=new)
            to = out[t - MARGIN] if t >= MARGIN else spare
            np.subtract(state, new, out=to)
            z += 1
            z *= 0.5
            to *= z
            to += new
            state, spare = to, state if t < MARGIN else spare
        return out

    def label(self, x: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Of each window (MARGIN + CORE + MARGIN bytes) the sums of all languages' probabilities over the counted ones of its CORE positions."""
        flat = np.ascontiguousarray(x.T, np.intp)
        forward, backward = self._states(flat, "f"), self._states(flat[::-1], "b")[::-1]
        total = np.zeros((len(x), len(self.languages)))
        for a in range(0, CORE, 32):
            logits = np.concatenate([forward[a : a + 32], backward[a : a + 32]], 2) @ self.p["o"] + self.p["c"]
            logits -= logits.max(2, keepdims=True)
            np.exp(logits, out=logits)
            logits *= (counted.T[a : a + 32] / logits.sum(2))[:, :, None]
            total += logits.sum(0)
        return total


def windows(data: np.ndarray, offsets: np.ndarray, at_once: int = _AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (bytes one after another, and offsets) as windows, some at a time: their bytes, which CORE positions are letters', and their texts.

    Every byte of a text is in the CORE of one window; around a text lie newlines.
    """
    n = -(-np.diff(offsets) // CORE)
    texts = np.repeat(np.arange(len(n)), n)
    starts = offsets[texts] + (np.arange(len(texts)) - np.repeat(np.cumsum(n) - n, n)) * CORE
    for a in range(0, len(texts), at_once):
        text, start = texts[a : a + at_once], starts[a : a + at_once]
        at = start[:, None] + np.arange(-MARGIN, CORE + MARGIN)
        inside = (at >= offsets[text][:, None]) & (at < offsets[text + 1][:, None])
        x = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 10).astype(np.uint8)
        yield x, (inside & _LETTER_BYTE[x])[:, MARGIN : MARGIN + CORE], text


def probabilities(model: BiGru, texts: pa.Array) -> np.ndarray:
    """Of each text the mean of the languages' probabilities over the bytes of its letters; zeros without any."""
    out = np.zeros((len(texts), len(model.languages)))
    for first, part in words.slices(texts):
        data, offsets = words.text_bytes(part)
        for x, counted, text in windows(np.frombuffer(_LOWER, np.uint8)[data], offsets):
            np.add.at(out, first + text, model.label(x, counted))
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, stretch): STRETCHES of each text, drawn from all of it and the newlines around it."""
    for batch in batches:
        langs, found = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = bytes(text.as_buffer()).translate(_LOWER)
            rng = random.Random(zlib.crc32(data))
            data = b"\n" * MARGIN + data + b"\n" * max(MARGIN, STRETCH)
            for _ in range(STRETCHES):
                at = rng.randrange(len(data) - STRETCH)
                langs.append(lang)
                found.append(data[at : at + STRETCH])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "stretch"])


def train_model(labelled: DataFrame) -> BiGru | None:
    """A network fitted on the sample of ``labelled`` (text, lang); None if no text has letters and a language."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(_HAS_LETTER)).withColumn("h", F.xxhash64("text"))
    # About four times the sample is sorted, not all of a language's distinct texts, however often one of them occurs. The shares are a
    # row for each language, as are the network's outputs.
    share = rows.groupBy("lang").agg((F.lit(4.0 * TRAIN_TEXTS) / F.approx_count_distinct("h")).alias("share"))
    low = (F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("share")
    near = rows.join(F.broadcast(share), "lang").where(low).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= TRAIN_TEXTS).select("lang", "text")
    # STRETCHES of TRAIN_TEXTS texts a language, STRETCH bytes each, come to the driver.
    found = sorted(tuple(r) for r in sample.mapInArrow(_stretches, "lang string, stretch binary").collect())
    languages = sorted({lang for lang, _ in found})
    if not languages:
        return None
    model = BiGru(languages)
    model.train([(languages.index(lang), bytes(stretch)) for lang, stretch in found], STEPS)
    return model


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every whole text.

    Rows whose id, as text, has a CRC-32 of remainder ``fold`` by ``folds`` are held out; the network learns from others
    with a language. ``score`` is the mean probability of the predicted language over all letter positions. A null
    text, or one without letters (Unicode category L), is ``und`` with score 0, as is everything if nothing can be learned
    from. Null ids count as an empty text for the fold. Repeated rows are each answered, and alike; a text that occurs often is
    learned from once. Equal scores go to the first language by name. A very long text is read whole, some windows at a time.
    Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    id_, text = scratch.column(docs, id_col).cast("long"), scratch.column(docs, text_col).cast("string")
    held_out = F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == fold
    rows = docs.select(id_.alias("id"), held_out.alias("held_out"), text.alias("text"), scratch.column(docs, lang_col).cast("string").alias("lang"))
    model = train_model(rows.where("not held_out").select("text", "lang"))
    rows = rows.select("id", "held_out", F.coalesce(F.col("text").rlike(_HAS_LETTER), F.lit(False)).alias("has_letter"), "text")
    if model is None:
        out = rows.select("id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
        return out.withColumnRenamed("id", id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_identify(shared), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def _identify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, UNDETERMINED])
        for batch in batches:
            found = probabilities(model, batch.column(3))
            has_letter = np.asarray(batch.column(2)) & found.any(axis=1)
            picked = names.take(pa.array(np.where(has_letter, found.argmax(1), len(names) - 1)))
            score = np.where(has_letter, np.minimum(found.max(1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), picked, pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    return run
