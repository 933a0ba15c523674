"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions.

Patterns (email, ip, card, phone) match leftmost without overlap, each in
linear time: an email is searched from its @, digit runs are entered at their
first digit only.

Model: labelled spans are the pattern matches of a bounded sample of
documents (``sample_docs``, the first in hash order that hold a digit or @) and
typographic variants of them that the patterns miss (other separators, spaced
or bracketed dots, no country code). Windows without spans around digits and @
are the negatives. A bidirectional LSTM over character classes gives emissions
for BIO tags, a CRF with learned transitions scores tag paths; both are trained
in numpy by Adam on the exact CRF likelihood.

Decoding: every span must hold a digit or an @, so only text within ``reach``
characters of one, and on to the next space, is decoded; elsewhere no span can be. Each such stretch is
cut into overlapping windows. A character's emissions are the mean over its
windows, weighted by the distance to the window's edge, and one Viterbi path
runs over the whole stretch, so windows cannot disagree. Spans of the path whose
characters have a mean posterior of ``confidence`` or more are added unless they
touch a pattern's span.

Defined results: null text counts as empty, without spans. Rows with equal or
null ids are rows of their own. Without any pattern match in the sample there
is no model and only the patterns report. An empty table gives an empty
result. Positions count code points, the end is exclusive. Other columns are
not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeflow.llm.common import map_batches, utf8, written

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, TRAIN_WINDOWS, STEPS, BATCH, WIDTH, HIDDEN, EMBED, SEED = 1500, 4000, 350, 32, 64, 20, 10, 1
STRIDE, REACH, CONFIDENCE = 32, 24, 0.97
WINDOWS, CHARACTERS = 512, 1 << 14  # decoded at once

# patterns fixed by the contract; a run of digits is entered at its start, as every later entry fails alike
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_TRIGGERS = re.compile(r"[0-9@]+")
_RUN = re.compile(r"\S*")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def pattern_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, in order."""
    if not text or not _TRIGGER.search(text):
        return []
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
            if all(len(d) <= 3 and int(d or "0") <= 255 for d in (g.lstrip("0") for g in m.groups()))]
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _char_classes():
    """Class of each ASCII code, and of other characters by kind; 0 pads."""
    return {c: k + 1 for k, c in enumerate(map(chr, range(32, 127)))}


_OTHER_LETTER, _OTHER_DIGIT, _SPACE, _OTHER = 96, 97, 98, 99
N_CLASSES = 100
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 2k + 1 begins and 2k + 2 continues kind k


def encode_chars(s: str) -> list[int]:
    table = _char_classes()
    return [table.get(c) or (_OTHER_LETTER if c.isalpha() else _OTHER_DIGIT if c.isdigit()
                             else _SPACE if c.isspace() else _OTHER) for c in s]


class Tagger:
    """Character BiLSTM with a CRF layer; all arrays are numpy."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN, embed: int = EMBED):
        import numpy as np
        r = np.random.default_rng(seed)
        h = self.hidden = hidden
        u = lambda *s: r.uniform(-1, 1, s) * (1.0 / s[0]) ** 0.5
        self.p = {"E": r.normal(0, 0.3, (N_CLASSES, embed)), "O": u(2 * h, TAGS), "o": np.zeros(TAGS),
                  "A": np.zeros((TAGS, TAGS)), "S": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {"X" + d: u(embed, 4 * h), "H" + d: u(h, 4 * h), "B" + d: np.zeros(4 * h)}
            self.p["B" + d][h:2 * h] = 1.0  # forget gates begin open
        bad = np.zeros((TAGS, TAGS))
        for t in range(2, TAGS, 2):  # a continuation follows only its own kind
            bad[:, t] = -1e4
            bad[t - 1, t] = bad[t, t] = 0
        self.bad, self.bad_start = bad, np.array([-1e4 if t and t % 2 == 0 else 0.0 for t in range(TAGS)])

    def _lstm(self, x, d: str, keep: bool):
        import numpy as np
        h, p = self.hidden, self.p
        n, length = x.shape[:2]
        pre = x @ p["X" + d] + p["B" + d]
        hs, cs = np.zeros((length + 1, n, h)), np.zeros((length + 1, n, h))
        gates = np.zeros((length, n, 4 * h)) if keep else None
        for t in range(length):
            g = pre[:, t] + hs[t] @ p["H" + d]
            g[:, :3 * h] = 1 / (1 + np.exp(-g[:, :3 * h]))
            g[:, 3 * h:] = np.tanh(g[:, 3 * h:])
            cs[t + 1] = g[:, h:2 * h] * cs[t] + g[:, :h] * g[:, 3 * h:]
            hs[t + 1] = g[:, 2 * h:3 * h] * np.tanh(cs[t + 1])
            if keep:
                gates[t] = g
        return hs, cs, gates

    def emissions(self, chars, keep: bool = False):
        """(windows, length, tags) for (windows, length) character classes."""
        import numpy as np
        x = self.p["E"][chars]
        f = self._lstm(x, "f", keep)
        b = self._lstm(x[:, ::-1], "b", keep)
        both = np.concatenate((f[0][1:].transpose(1, 0, 2), b[0][1:][::-1].transpose(1, 0, 2)), axis=2)
        e = both @ self.p["O"] + self.p["o"]
        return (e, x, f, b, both) if keep else e

    def _forward(self, e, lengths=None):
        import numpy as np
        a = self.p["A"] + self.bad
        alpha = np.empty_like(e)
        alpha[:, 0] = e[:, 0] + self.p["S"] + self.bad_start
        for t in range(1, e.shape[1]):
            s = alpha[:, t - 1, :, None] + a
            m = s.max(1)
            now = m + np.log(np.exp(s - m[:, None]).sum(1)) + e[:, t]
            alpha[:, t] = now if lengths is None else np.where((t < lengths)[:, None], now, alpha[:, t - 1])
        m = alpha[:, -1].max(1)
        return alpha, m + np.log(np.exp(alpha[:, -1] - m[:, None]).sum(1)), a

    def _backward(self, e, a, lengths=None):
        import numpy as np
        beta = np.zeros_like(e)
        for t in range(e.shape[1] - 2, -1, -1):
            s = a[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            m = s.max(2)
            now = m + np.log(np.exp(s - m[:, :, None]).sum(2))
            beta[:, t] = now if lengths is None else np.where((t + 1 < lengths)[:, None], now, 0.0)
        return beta

    def marginals(self, e, lengths=None):
        """Tag posteriors; a sequence ends at its length, what follows has no meaning."""
        import numpy as np
        alpha, z, a = self._forward(e, lengths)
        return np.exp(alpha + self._backward(e, a, lengths) - z[:, None, None])

    def viterbi(self, e, lengths=None):
        """The best tag path of each sequence; a sequence ends at its length."""
        import numpy as np
        a = self.p["A"] + self.bad
        best = e[:, 0] + self.p["S"] + self.bad_start
        back = np.empty(e.shape, dtype=np.int8)
        stay = np.arange(e.shape[2], dtype=np.int8)
        for t in range(1, e.shape[1]):
            s = best[:, :, None] + a
            on = np.ones((len(e), 1), bool) if lengths is None else (t < lengths)[:, None]
            back[:, t] = np.where(on, s.argmax(1), stay)
            best = np.where(on, s.max(1) + e[:, t], best)
        path = np.empty(e.shape[:2], dtype=np.int8)
        path[:, -1] = best.argmax(1)
        rows = np.arange(len(e))
        for t in range(e.shape[1] - 1, 0, -1):
            path[:, t - 1] = back[rows, t, path[:, t]]
        return path

    def gradients(self, chars, tags):
        """(loss, gradients) of the mean negative log likelihood."""
        import numpy as np
        p, h = self.p, self.hidden
        e, x, f, b, both = self.emissions(chars, True)
        n, length = chars.shape
        alpha, z, a = self._forward(e)
        beta = self._backward(e, a)
        rows, at = np.arange(n)[:, None], np.arange(length)[None]
        gold = e[rows, at, tags].sum(1) + p["S"][tags[:, 0]] + a[tags[:, :-1], tags[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None, None])
        g = {"S": de[:, 0].sum(0) / n, "A": np.zeros_like(p["A"])}
        np.subtract.at(g["S"], tags[:, 0], 1 / n)
        for t in range(length - 1):
            s = alpha[:, t, :, None] + a + (e[:, t + 1] + beta[:, t + 1])[:, None, :] - z[:, None, None]
            g["A"] += np.exp(s).sum(0) / n
        np.subtract.at(g["A"], (tags[:, :-1], tags[:, 1:]), 1 / n)
        de[rows, at, tags] -= 1
        de /= n
        g["O"] = np.einsum("nlh,nlt->ht", both, de)
        g["o"] = de.sum((0, 1))
        dboth = de @ p["O"].T
        dx = np.zeros_like(x)
        for d, (hs, cs, gates), up, xs in (("f", f, dboth[:, :, :h], x), ("b", b, dboth[:, ::-1, h:], x[:, ::-1])):
            dh, dc = np.zeros((n, h)), np.zeros((n, h))
            dpre = np.empty((n, length, 4 * h))
            for t in range(length - 1, -1, -1):
                q = gates[t]
                i, fo, o, c = q[:, :h], q[:, h:2 * h], q[:, 2 * h:3 * h], q[:, 3 * h:]
                dh = dh + up[:, t]
                tc = np.tanh(cs[t + 1])
                dc = dc + dh * o * (1 - tc * tc)
                dg = np.concatenate((dc * c * i * (1 - i), dc * cs[t] * fo * (1 - fo), dh * tc * o * (1 - o),
                                     dc * i * (1 - c * c)), axis=1)
                dpre[:, t] = dg
                dh, dc = dg @ p["H" + d].T, dc * fo
            g["X" + d] = np.einsum("nle,nlg->eg", xs, dpre)
            g["H" + d] = np.einsum("lnh,nlg->hg", hs[:-1], dpre)
            g["B" + d] = dpre.sum((0, 1))
            back = dpre @ p["X" + d].T
            dx += back if d == "f" else back[:, ::-1]
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], chars, dx)
        return float((z - gold).mean()), g

    def fit(self, chars, tags, steps: int = STEPS, batch: int = BATCH, seed: int = SEED, rate: float = 0.02):
        """Adam on random batches; returns the losses."""
        import numpy as np
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = r.integers(0, len(chars), batch)
            loss, g = self.gradients(chars[pick], tags[pick])
            losses.append(loss)
            norm = sum(float((x * x).sum()) for x in g.values()) ** 0.5
            for k in self.p:
                d = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                now = rate * (1 - 0.9 * step / steps)
                self.p[k] -= now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return losses


def variant(kind: int, s: str, r) -> str:
    """Another spelling of a span, which the patterns do not find."""
    k = int(r.integers(0, 3))
    if kind == 0:
        local, _, domain = s.partition("@")
        return (f"{local} @ {domain}", f"{local}@{domain.replace('.', ' . ')}", f"{local}@{domain.replace('.', '(dot)')}")[k]
    if kind == 1:
        return s.replace(".", ("[.]", " . ", "(.)")[k])
    if kind == 2:
        d, sep = _digits(s), (".", "_", " - ")[k]
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4))
    d = _digits(s)
    d = d[-10:]
    return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}")[k]


def training_windows(rows: list[tuple[str, list[tuple[int, int, int]]]], seed: int = SEED, width: int = WIDTH):
    """(classes, tags) arrays from (text, spans) rows: each as it is and, if it has spans, with variants."""
    import numpy as np
    r = np.random.default_rng(seed)
    chars, tags = [], []
    for text, spans in rows:
        for vary in ([False, True] if spans else [False]):
            out, marks, at = "", [], 0
            for s, k, e in spans:
                if s < at:
                    continue
                own = variant(k, text[s:e], r) if vary and r.random() < 0.7 else text[s:e]
                out += text[at:s] + own
                marks += [0] * (s - at) + [2 * k + 1] + [2 * k + 2] * (len(own) - 1)
                at = e
            out += text[at:]
            marks += [0] * (len(text) - at)
            cut = int(r.integers(0, max(1, len(out) - width + 1)))
            piece, mark = out[cut:cut + width], marks[cut:cut + width]
            if mark and mark[0] and mark[0] % 2 == 0:  # a span cut by the window begins with it
                mark[0] -= 1
            lead = int(r.integers(0, width - len(piece) + 1))
            chars.append([0] * lead + encode_chars(piece) + [0] * (width - len(piece) - lead))
            tags.append([0] * lead + mark + [0] * (width - len(piece) - lead))
    return np.array(chars, dtype=np.int64).reshape(-1, width), np.array(tags, dtype=np.int64).reshape(-1, width)


def stretches(text: str, reach: int = REACH) -> list[tuple[int, int]]:
    """The parts of a text within ``reach`` characters of a digit or @, on to the end of the runs of non-spaces they
    touch, so that no address is cut."""
    out: list[list[int]] = []
    for m in _TRIGGERS.finditer(text):
        s, e = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    runs: list[list[int]] = []
    for s, e in out:
        s, e = _run_start(text, s), _RUN.match(text, e).end()
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [(s, e) for s, e in runs]


def _run_start(text: str, at: int) -> int:
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return at


def _batches(lengths: list[int], most: int):
    """Sequences in the order of their lengths, in batches of ``most`` characters with their padding, or of one sequence."""
    own: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if own and (len(own) + 1) * lengths[i] > most:
            yield own
            own = []
        own.append(i)
    if own:
        yield own


def _emissions(model: Tagger, texts: list[str], width: int, stride: int):
    """Emissions of each text: every window of every text is a row of its own, at most ``WINDOWS`` at a time; a character's are
    the mean over its windows, weighted by the distance to the window's edge. A text's do not depend on the others."""
    import numpy as np
    weight = np.minimum(np.arange(1, width + 1), np.arange(width, 0, -1)).astype(float)
    padded = [max(width, -(-max(0, len(t) - width) // stride) * stride + width) for t in texts]
    first = np.concatenate(([0], np.cumsum(padded)))
    chars = np.zeros(first[-1], dtype=np.int16)
    for k, t in enumerate(texts):
        chars[first[k]:first[k] + len(t)] = encode_chars(t)
    starts = np.concatenate([first[k] + np.arange(0, p - width + 1, stride) for k, p in enumerate(padded)])
    total, mass = np.zeros((first[-1], TAGS)), np.zeros(first[-1])
    for lo in range(0, len(starts), WINDOWS):
        own = starts[lo:lo + WINDOWS]
        for s, e in zip(own, model.emissions(chars[own[:, None] + np.arange(width)].astype(np.int64))):
            total[s:s + width] += e * weight[:, None]
            mass[s:s + width] += weight
    total /= mass[:, None]
    return [total[first[k]:first[k] + len(t)] for k, t in enumerate(texts)]


def decode(model: Tagger, texts: list[str], width: int = WIDTH, stride: int = STRIDE, confidence: float = CONFIDENCE):
    """For each text (a stretch) the model's spans (start, kind number, end). Memory follows ``CHARACTERS`` or the
    longest text, a few hundred bytes a character."""
    import numpy as np
    out: list[list] = [[] for _ in texts]
    for own in _batches([len(t) for t in texts], CHARACTERS):
        own = [i for i in own if texts[i]]
        if not own:
            continue
        each = _emissions(model, [texts[i] for i in own], width, stride)
        lengths = np.array([len(x) for x in each])
        e = np.zeros((len(own), lengths.max(), TAGS))
        for k, x in enumerate(each):
            e[k, :len(x)] = x
        path = model.viterbi(e, lengths)
        path[np.arange(path.shape[1]) >= lengths[:, None]] = 0
        hit = np.flatnonzero((path > 0).any(1))
        if not len(hit):
            continue
        sure = model.marginals(e[hit], lengths[hit])
        for k, m in zip(hit.tolist(), sure):
            i, t = own[k], 0
            p = path[k].tolist()
            while t < len(texts[i]):
                if p[t] % 2 == 1:
                    end = t + 1
                    while end < len(texts[i]) and p[end] == p[t] + 1:
                        end += 1
                    if (m[np.arange(t, end), path[k, t:end]].mean() >= confidence
                            and _TRIGGER.search(texts[i], t, end)):
                        out[i].append((t, p[t] // 2, end))
                    t = end
                else:
                    t += 1
    return out


def trained(docs: DataFrame, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS,
            train_windows: int = TRAIN_WINDOWS, steps: int = STEPS) -> Tagger | None:
    """A tagger from at most ``train_windows`` stretches of at most ``sample_docs`` documents."""
    text = utf8(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(F.regexp_like("text", F.lit("[0-9@]")))
    own = F.xxhash64("id", "text")
    chosen = written(rows.select(own.alias("h")).distinct().orderBy("h").limit(sample_docs), "sample")

    def pieces(batches):
        for b in batches:
            got, spans = [], []
            for t in b["text"].to_pylist():
                found = pattern_spans(t)
                for a, z in stretches(t):
                    for s in range(a, z, 4 * WIDTH):  # a long stretch gives several pieces
                        e = min(z, s + 4 * WIDTH)
                        got.append(t[s:e])
                        spans.append([[x - s, k, y - s] for x, k, y in found if s <= x and y <= e])
            yield {"text": got, "spans": spans}

    sampled = rows.withColumn("h", own).join(F.broadcast(chosen), "h", "left_semi").select("text")
    made = map_batches(sampled, pieces, "text string, spans array<array<int>>").distinct()
    got = made.orderBy(F.xxhash64("text"), "text").limit(train_windows).collect()
    data = [(r.text, [tuple(s) for s in r.spans]) for r in got]
    if not any(s for _, s in data):
        return None
    model = Tagger()
    model.fit(*training_windows(data), steps=steps)
    return model


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
         train_windows: int = TRAIN_WINDOWS, steps: int = STEPS, confidence: float = CONFIDENCE) -> DataFrame:
    """``(id, base, spans)`` per row: arrays of (start, kind number, end) in order; ``spans`` holds ``base`` too."""
    model = trained(docs, id_col, text_col, sample_docs, train_windows, steps)

    def scan(batches):
        for b in batches:
            base, parts, owner, extra = [], [], [], []
            for n, t in enumerate(b["text"].to_pylist()):
                base.append(pattern_spans(t))
                extra.append([])
                if model is not None:
                    for s, e in stretches(t):
                        parts.append(t[s:e])
                        owner.append((n, s))
            if parts:
                for (n, s), found in zip(owner, decode(model, parts, confidence=confidence)):
                    extra[n] += [(s + x, k, s + y) for x, k, y in found
                                 if not any(p < s + y and s + x < q for p, _, q in base[n])]
            both = [sorted({*x, *y}) for x, y in zip(base, extra)]
            row = lambda v: [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in v]
            yield {"id": b["id"], "base": row(base), "spans": row(both)}

    span = "array<struct<start:int,kind:int,end:int>>"
    own = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return map_batches(own, scan, f"id long, base {span}, spans {span}").withColumnRenamed("id", id_col)
