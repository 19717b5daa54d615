"""Training of the recognizer of personal data, in numpy: ``python -m textloom.llm.pii_train RECORDS.parquet NAMES.parquet SECONDS OUT.npz [START.npz]``.

Backpropagation through time of the bidirectional LSTM, with the CRF's log-likelihood as objective. Half of the windows come from at most ``MAX_TEXTS``
real texts (the documented bound of the labelled sample), whose labelled spans are mostly replaced by invented ones of the same kind; the other
half are invented sentences set between real ones, or invented pieces between the words of prose. Processes share the work: each computes the gradient of its own batch, and one step follows their mean. A
twentieth of the texts and a fifth of the sentences are held out; recall and precision on both are printed.
"""

from __future__ import annotations

import multiprocessing
import os
import random
import sys
import time

import numpy as np
import regex

from .pii import KINDS, WEIGHTS, VOCABULARY, Tagger, characters, spans_of, windows
from .pii_labels import doubtful, spans
from .pii_synth import Inventor

MAX_TEXTS, EMBEDDING, HALF, BATCH, RATE, SEED = 120_000, 32, 48, 64, 6e-3, 1
LABELS = 1 + len(KINDS)
#: Share of labelled spans of real texts that invented ones replace, and batches that are drawn at once.
REPLACED, POOL = 0.6, 24
SCRIPTS = (("bn", regex.compile(r"\p{Bengali}")), ("ta", regex.compile(r"\p{Tamil}")), ("ne", regex.compile(r"(?:छ|थियो|गर्नुहोस्)")), ("hi", regex.compile(r"\p{Devanagari}")), ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("lus", regex.compile("[âîûṭ]")))
Example = tuple[np.ndarray, np.ndarray]
Spans = list[tuple[int, int, int]]


def language(text: str) -> str:
    return next((lang for lang, pattern in SCRIPTS if pattern.search(text)), "en")


def cut(text: str, found: Spans, out: list[Example], at: int | None = None, bad: list[tuple[int, int]] = []) -> None:
    """The windows of a labelled text: all, or the one that begins at ``at``; none with a doubtful place."""
    ids, starts = characters(text)
    labels = np.zeros(len(ids), np.uint8)
    for low, high, kind in found:
        labels[np.searchsorted(starts, low, "right") - 1 : np.searchsorted(starts, high)] = kind + 1
    for low, high in bad:
        labels[np.searchsorted(starts, low, "right") - 1 : np.searchsorted(starts, high)] = 255
    for a, b in windows(len(ids)) if at is None else [(at, min(len(ids), at + 240))]:
        if b > a and not (labels[a:b] == 255).any():
            out.append((ids[a:b], labels[a:b]))


def swapped(text: str, found: Spans, invent: Inventor) -> tuple[str, Spans]:
    """A real text with most of its spans replaced by invented ones of their kind."""
    out, made, at, lang = "", [], 0, language(text)
    for low, high, kind in found:
        new = text[low:high]
        if kind != 2 and invent.rng.random() < (0.9 if kind == 4 else REPLACED):  # numbers of papers keep the form that their cue asks for
            of = lang if kind != 4 or not new.isascii() else "en"
            new = invent.fill(KINDS[kind], of)[0]
        out += text[at:low]
        made.append((len(out), len(out) + len(new), kind))
        out, at = out + new, high
    return out + text[at:], made


def between(text: str, known: Spans, invent: Inventor, from_held: bool = False) -> tuple[str, Spans]:
    """One to three invented sentences set between the lines or sentences of a real text."""
    rng, lang = invent.rng, language(text)
    places = [0, *(m.end() for m in regex.finditer(r"[.!?।॥。]\s|\n", text) if not any(a < m.end() < b for a, b, _ in known)), len(text)]
    spot = rng.choice(places)
    made, inner = "", []
    for _ in range(rng.choice((1, 1, 2, 3))):
        sentence, found, _ = invent.sentence(lang if rng.random() < 0.6 else "en" if rng.random() < 0.6 else None, from_held)
        made += rng.choice((" ", " ", "\n")) if made else ""
        inner += [(len(made) + a, len(made) + b, k) for a, b, k in found]
        made += sentence
    before, after = text[:spot], text[spot:]
    before += " " if before and not before[-1].isspace() else ""
    after = (rng.choice((" ", " ", "\n")) + after) if after else ""
    out = before + made + after
    shift = len(before) + len(made) + len(after) - len(text[spot:]) - spot
    return out, sorted([s for s in known if s[1] <= spot] + [(a + shift, b + shift, k) for a, b, k in known if a >= spot] + [(len(before) + a, len(before) + b, k) for a, b, k in inner])


def within(text: str, known: Spans, invent: Inventor) -> tuple[str, Spans]:
    """A few pieces of personal data, or of what resembles it, set between the words of English prose."""
    rng = invent.rng
    places = [m.start() for m in regex.finditer(r"(?<=\S) (?=\S)", text) if not any(a <= m.start() <= b for a, b, _ in known)]
    out, found, at = "", [], 0
    cuts = sorted(rng.sample(places, min(len(places), rng.choice((1, 2, 3, 4)))))
    for spot in [*cuts, len(text)]:
        found += [(a - at + len(out), b - at + len(out), k) for a, b, k in known if at <= a and b <= spot]
        out += text[at:spot]
        at = spot
        if spot in cuts:
            piece, spans_ = invent.phrase()
            out += rng.choice((" ", " ", " ", ", ", "; ", ". "))
            found += [(len(out) + a, len(out) + b, k) for a, b, k in spans_]
            out += piece + rng.choice(("", "", "", ",", ".", ";"))
    return out, sorted(found)


def prose() -> list[str]:
    """Paragraphs of English prose that come with Python."""
    from pydoc_data.topics import topics

    parts = (regex.sub(r"\s+", " ", regex.sub(r"[*`\"_]", "", part)).strip() for topic in topics.values() for part in topic.split("\n\n"))
    return [part for part in parts if 80 < len(part) < 600 and len(regex.findall(r"[a-zA-Z ,.]", part)) > 0.95 * len(part)]


def titled(text: str, known: Spans) -> str:
    """The text with every word outside its spans in capitals at the beginning, as headlines have it."""
    out, at = "", 0
    for low, high, _ in [*known, (len(text), len(text), 0)]:
        out += regex.sub(r"(?<![\p{L}\p{M}'])[a-z]", lambda m: m[0].upper(), text[at:low]) + text[low:high]
        at = high
    return out


def drawn(texts: list[str], named: list[str], given: set[str], family: set[str], invent: Inventor, size: int) -> list[list[Example]]:
    """Batches of windows of like lengths."""
    out: list[Example] = []
    rng, plain = invent.rng, prose()
    while len(out) < size * BATCH:
        text = rng.choice(texts)
        if len(text) > 1200:
            start = rng.randrange(len(text) - 1000)
            text = text[start : start + 1000]
        known = spans(text, given, family)
        way = rng.random()
        if way < 0.3 and language(text) in ("en", "lus") or way < 0.12:
            if way < 0.08:
                text, known = rng.choice(plain), []
            if language(text) in ("en", "lus"):
                text, all_ = within(text, known, invent)
                cut(text, all_, out, bad=[x for x in doubtful(text, all_) if rng.random() < 0.3] if known else [])
        elif way < 0.55:
            if way < 0.3 and named:
                text = rng.choice(named)
                known = spans(text, given, family)
            if known or rng.random() < 0.3:
                text, known = swapped(text, known, invent)
                headline = language(text) in ("en", "lus") and rng.random() < 0.1
                bad = [] if headline else doubtful(text, known)
                cut(titled(text, known) if headline else text, known, out, bad=bad)
        else:
            text, all_ = between(text, known, invent)
            first = min((a for a, *_ in all_), default=0)
            cut(text, all_, out, max(0, len(characters(text[:first])[0]) - rng.randrange(150)) if first else 0, [x for x in doubtful(text, all_) if rng.random() < 0.5])
    out.sort(key=lambda x: len(x[0]))
    batches = [out[k : k + BATCH] for k in range(0, len(out) - BATCH + 1, BATCH)]
    rng.shuffle(batches)
    return batches


def initial(rng: np.random.Generator, start: str | None = None) -> dict[str, np.ndarray]:
    """Random weights, or those of a file to go on from."""
    if start:
        with np.load(start) as stored:
            return {name: stored[name].astype(np.float32) for name in stored.files}
    w = {"emb": rng.normal(0, 0.3, (VOCABULARY, EMBEDDING)), "wo": rng.normal(0, 0.2, (2 * HALF, LABELS)), "bo": np.zeros(LABELS), "trans": np.eye(LABELS)}
    for d in "fb":
        w["w" + d] = rng.normal(0, EMBEDDING**-0.5, (EMBEDDING, 4 * HALF))
        w["u" + d] = rng.normal(0, HALF**-0.5, (HALF, 4 * HALF)) * 0.8
        w["b" + d] = np.concatenate([np.zeros(HALF), np.ones(HALF), np.zeros(2 * HALF)])
    return {k: v.astype(np.float32) for k, v in w.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(x: np.ndarray, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States of one direction for inputs (steps, windows, gates); mask is (steps, windows, 1)."""
    steps, n, _ = x.shape
    half = u.shape[0]
    hs, cs, acts = np.zeros((steps + 1, n, half), np.float32), np.zeros((steps + 1, n, half), np.float32), np.empty_like(x)
    for s in range(steps):
        z = x[s] + hs[s] @ u
        a = acts[s]
        a[:, : 3 * half] = sigmoid(z[:, : 3 * half])
        a[:, 3 * half :] = np.tanh(z[:, 3 * half :])
        cs[s + 1] = (a[:, half : 2 * half] * cs[s] + a[:, :half] * a[:, 3 * half :]) * mask[s]
        hs[s + 1] = a[:, 2 * half : 3 * half] * np.tanh(cs[s + 1])
    return hs[1:], (hs, cs, acts)


def backward(dh: np.ndarray, u: np.ndarray, mask: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the inputs, of the inner weights)."""
    hs, cs, acts = kept
    steps, n, half = dh.shape
    dx = np.empty_like(acts)
    nh, nc = np.zeros((n, half), np.float32), np.zeros((n, half), np.float32)
    for s in range(steps - 1, -1, -1):
        i, f, o, g = (acts[s][:, k * half : (k + 1) * half] for k in range(4))
        t = np.tanh(cs[s + 1])
        d = dh[s] + nh
        dc = (nc + d * o * (1 - t * t)) * mask[s]
        z = dx[s]
        z[:, :half], z[:, half : 2 * half] = dc * g * i * (1 - i), dc * cs[s] * f * (1 - f)
        z[:, 2 * half : 3 * half], z[:, 3 * half :] = d * t * o * (1 - o) * mask[s], dc * i * (1 - g * g)
        nh, nc = z @ u.T, dc * f
    return dx, np.einsum("snh,sng->hg", hs[:-1], dx, optimize=True)


def total(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def crf(scores: np.ndarray, trans: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log-likelihood, gradient of scores, of transitions)."""
    steps, n, labels = scores.shape
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for s in range(1, steps):
        step = total(ahead[s - 1][:, :, None] + trans, 1) + scores[s]
        ahead[s] = np.where(mask[s], step, ahead[s - 1])
    for s in range(steps - 2, -1, -1):
        step = total(trans + (scores[s + 1] + behind[s + 1])[:, None, :], 2)
        behind[s] = np.where(mask[s + 1], step, behind[s + 1])
    whole = total(ahead[-1], 1)
    grad = np.exp(ahead + behind - whole[None, :, None]) * mask
    dtrans, rows = np.zeros_like(trans), np.arange(n)
    loss = whole.sum()
    for s in range(steps):
        on = mask[s, :, 0]
        grad[s, rows, gold[s]] -= on
        loss -= (scores[s, rows, gold[s]] * on).sum()
        if s:
            pair = np.exp(ahead[s - 1][:, :, None] + trans + (scores[s] + behind[s])[:, None, :] - whole[:, None, None])
            dtrans += (pair * on[:, None, None]).sum(0)
            np.subtract.at(dtrans, (gold[s - 1], gold[s]), on)
            loss -= (trans[gold[s - 1], gold[s]] * on).sum()
    return float(loss), grad, dtrans


def step(w: dict[str, np.ndarray], batch: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, dict[str, np.ndarray]]:
    lengths = np.array([len(ids) for ids, _ in batch])
    steps, n = lengths.max(), len(batch)
    ids, gold = np.zeros((steps, n), np.int64), np.zeros((steps, n), np.int64)
    for k, (a, b) in enumerate(batch):
        ids[: len(a), k], gold[: len(b), k] = a, b
    mask = (np.arange(steps)[:, None] < lengths)[:, :, None].astype(np.float32)
    emb = w["emb"][ids]
    kept, hidden = {}, []
    for d in "fb":
        x = emb @ w["w" + d] + w["b" + d]
        flip = slice(None, None, -1 if d == "b" else 1)
        hs, kept[d] = forward(x[flip], w["u" + d], mask[flip])
        hidden.append(hs[flip])
    h = np.concatenate(hidden, 2)
    scores = h @ w["wo"] + w["bo"]
    loss, ds, dtrans = crf(scores, w["trans"], gold, mask > 0)
    size = mask.sum()
    ds, dtrans = ds / size, dtrans / size
    g = {"trans": dtrans, "wo": np.einsum("snh,snl->hl", h, ds, optimize=True), "bo": ds.sum((0, 1))}
    dh = ds @ w["wo"].T
    demb = np.zeros_like(emb)
    for d, part in zip("fb", (dh[:, :, :HALF], dh[:, :, HALF:])):
        flip = slice(None, None, -1 if d == "b" else 1)
        dx, g["u" + d] = backward(part[flip], w["u" + d], mask[flip], kept[d])
        dx = dx[flip]
        g["w" + d], g["b" + d] = np.einsum("sne,sng->eg", emb, dx, optimize=True), dx.sum((0, 1))
        demb += dx @ w["w" + d].T
    g["emb"] = np.zeros_like(w["emb"])
    np.add.at(g["emb"], ids.ravel(), demb.reshape(-1, EMBEDDING))
    return loss / size, g


def worker(pipe, seed: int, texts: list[str], given: set[str], family: set[str], names: dict[str, list[str]], places: dict[str, list[str]]) -> None:
    """Answer each set of weights with (loss, gradient) of a batch of its own."""
    invent = Inventor(random.Random(seed), names, places)
    batches: list[list[Example]] = []
    named = [t for t in invent.rng.sample(texts, min(len(texts), 15_000)) if any(k == 4 for *_, k in spans(t, given, family))]
    while (w := pipe.recv()) is not None:
        batches = batches or drawn(texts, named, given, family, invent, POOL)
        pipe.send(step(w, batches.pop()))


def train(pipes: list, seconds: float, w: dict[str, np.ndarray], rate_of: float, save) -> dict[str, np.ndarray]:
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    began, t, losses = time.time(), 0, []
    while (gone := (time.time() - began) / seconds) < 1:
        for pipe in pipes:
            pipe.send(w)
        answers = [pipe.recv() for pipe in pipes]
        t += 1
        losses.append(np.mean([loss for loss, _ in answers]))
        g = {k: sum(one[k] for _, one in answers) / len(answers) for k in w}
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = rate_of * min(1.0, t / 50) * (0.03 + 0.97 * 0.5 * (1 + np.cos(np.pi * gone)))
        for k in w:
            x = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        if t % 100 == 0:
            print(f"{t} steps, {gone:.0%}, loss {np.mean(losses[-100:]):.5f}", flush=True)
            save(w)
    for pipe in pipes:
        pipe.send(None)
    return w


def words_of(texts: list[str], rng: random.Random) -> dict[str, list[str]]:
    """Words of each language, to name places with."""
    out: dict[str, list[str]] = {}
    for text in texts[:20_000]:
        lang = language(text)
        if lang in ("bn", "hi", "ne", "ta"):
            out.setdefault(lang, []).extend(w for w in rng.sample(text.split(), min(3, len(text.split()))) if regex.fullmatch(r"[\p{L}\p{M}]{4,12}", w) and not w.isascii())
    return out


def held_sentences(texts: list[str], given: set[str], family: set[str], invent: Inventor, count: int) -> list[tuple[str, Spans]]:
    """Held-out texts with held-out sentences between theirs."""
    return [between(text, spans(text, given, family), invent, True) for text in invent.rng.choices([t for t in texts if len(t) < 1000], k=count)]


def main(records: str, names: str, seconds: float, out: str = str(WEIGHTS), start: str | None = None, processes: int = os.cpu_count() or 1) -> None:
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    rng = np.random.default_rng(SEED)
    texts = [t for t in dict.fromkeys(ds.dataset(records).to_table(columns=["text"]).column("text").to_pylist()) if t]
    rng.shuffle(texts)
    texts = texts[:MAX_TEXTS]
    known = pq.read_table(names).to_pylist()
    given, family = ({row["name"] for row in known if row["kind"] == kind} for kind in ("given", "family"))
    by_lang: dict[str, list[str]] = {}
    for row in known:
        by_lang.setdefault(row["lang"], []).append(row["name"])
    places = words_of(texts, random.Random(SEED))
    held, texts = texts[: len(texts) // 20], texts[len(texts) // 20 :]
    pipes = []
    for k in range(processes):
        mine, other = multiprocessing.Pipe()
        multiprocessing.get_context("fork").Process(target=worker, args=(other, SEED + k, texts, given, family, by_lang, places), daemon=True).start()
        pipes.append(mine)
    save = lambda w: np.savez_compressed(out, **{k: x.astype(np.float16) for k, x in w.items()})
    w = train(pipes, seconds, initial(rng, start), RATE / 2 if start else RATE, save)
    save(w)
    model = Tagger({k: x.astype(np.float16).astype(np.float32) for k, x in w.items()})
    print("held-out texts", scores(model, [(t, spans(t, given, family)) for t in held[:4000]]))
    made = held_sentences(held, given, family, Inventor(random.Random(SEED + 99), by_lang, places), 6000)
    print("held-out sentences", recalls(model, made))
    print("of English texts", recalls(model, [x for x in made if language(x[0]) in ("en", "lus")]))


def scores(model: Tagger, labelled: list[tuple[str, Spans]]) -> dict[str, tuple[float, float, int]]:
    """By kind, over pairs of text and kind: (precision, recall, true pairs)."""
    hits = {kind: [0, 0, 0] for kind in KINDS}
    for (text, known), got in zip(labelled, model.labels([t for t, _ in labelled])):
        true, found = {KINDS[k] for *_, k in known}, {k for *_, k in spans_of(text, *got)}
        for kind in KINDS:
            hits[kind][0] += kind in true and kind in found
            hits[kind][1] += kind in found
            hits[kind][2] += kind in true
    return {kind: (round(a / max(1, b), 3), round(a / max(1, c), 3), c) for kind, (a, b, c) in hits.items()}


def recalls(model: Tagger, labelled: list[tuple[str, Spans]]) -> dict[str, tuple[float, float, int]]:
    """By kind, over spans: (share of found spans that meet a true one, share of true spans met by a found one, true spans)."""
    hits = {kind: [0, 0, 0, 0] for kind in KINDS}
    for (text, known), got in zip(labelled, model.labels([t for t, _ in labelled])):
        found = spans_of(text, *got)
        for a, b, k in known:
            hits[KINDS[k]][1] += any(kind == KINDS[k] and a < high and low < b for low, high, kind in found)
            hits[KINDS[k]][0] += 1
        for low, high, kind in found:
            hits[kind][3] += any(KINDS[k] == kind and a < high and low < b for a, b, k in known)
            hits[kind][2] += 1
    return {kind: (round(d / max(1, c), 3), round(b / max(1, a), 3), a) for kind, (a, b, c, d) in hits.items()}


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], float(sys.argv[3]), *sys.argv[4:6])
