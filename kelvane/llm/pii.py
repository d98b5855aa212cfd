"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans (`fit`); without given ones, a deterministic
generator writes sentences with surface forms that the patterns miss (spaced or dotted cards, phones
without a plus sign, spaced mail addresses, spaced dotted quads). A text is cut in overlapping windows
of WINDOW code points that start every STEP; each is decoded by Viterbi, and the spans of all windows
are reconciled over the whole text: those that a window holds whole go before those joined from parts that
neighbouring windows cut, then the better score wins, then the earlier start.

Every kind needs a digit or an @, so a window that has neither can yield no span: such windows
are not scored, unless the window beside them cuts a span, which changes no result (the decoder drops spans without one). Proposed spans
must also satisfy their kind's own rule (digit counts, Luhn, parts of at most 255, one @) and may not
touch a base span. Null or empty text: no spans.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_pieces

# Kinds in the order of the results, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW, STEP, EDGE = 96, 48, 2
TRIGGER = re.compile(r"[\d@]")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CLASSES, DIM, HIDDEN = 64, 10, 16


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches of the mail pattern, found from each @ so that long runs of
    letters cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def in_order(spans):
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


# ---- the network ----

def classes_of(codes: np.ndarray) -> np.ndarray:
    """Character classes: each ASCII mark its own, digits one, letters by case, the rest by kind."""
    out = np.full(codes.shape, 1, np.int64)
    marks = (codes >= 32) & (codes < 127)
    out[marks] = 3
    table = np.full(128, 2, np.int64)
    for k, c in enumerate(" !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        table[ord(c)] = 5 + k
    table[48:58] = 40
    for c in range(26):
        table[97 + c] = 41 + c % 20  # letters that come up in com, net, org, tel and the like keep apart
        table[65 + c] = 61
    table[10] = table[13] = table[9] = 62
    out = np.where(codes < 128, table[np.minimum(codes, 127)], out)
    return np.where(codes == 0, 0, out)


def _sig(x):
    return 1.0 / (1.0 + np.exp(-x))


def _lstm(x, w, u, b, back=False):
    """x: batch x time x dim. Hidden states batch x time x hidden, and what backward needs."""
    n, t, _ = x.shape
    hid = u.shape[0]
    h, c = np.zeros((n, hid), x.dtype), np.zeros((n, hid), x.dtype)
    out, kept = np.zeros((n, t, hid), x.dtype), [None] * t
    xw = x @ w + b
    for k in range(t - 1, -1, -1) if back else range(t):
        z = xw[:, k] + h @ u
        i, f, o = _sig(z[:, :hid]), _sig(z[:, hid:2 * hid] + 1), _sig(z[:, 2 * hid:3 * hid])
        g = np.tanh(z[:, 3 * hid:])
        before, prev = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, k] = h
        kept[k] = (i, f, o, g, tc, before, prev)
    return out, kept


def _lstm_back(d_out, x, w, u, kept, back=False):
    n, t, hid = d_out.shape
    dz_all = np.zeros((n, t, 4 * hid), x.dtype)
    dh, dc, du = np.zeros((n, hid), x.dtype), np.zeros((n, hid), x.dtype), np.zeros_like(u)
    for k in range(t) if back else range(t - 1, -1, -1):
        i, f, o, g, tc, before, prev = kept[k]
        dh = dh + d_out[:, k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[:, k] = dz
        du += prev.T @ dz
        dh, dc = dz @ u.T, dc * f
    flat = dz_all.reshape(-1, 4 * hid)
    return dz_all @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": g(CLASSES, DIM) * 3, "w1": g(DIM, 4 * HIDDEN), "u1": g(HIDDEN, 4 * HIDDEN), "b1": np.zeros(4 * HIDDEN, np.float32),
                  "w2": g(DIM, 4 * HIDDEN), "u2": g(HIDDEN, 4 * HIDDEN), "b2": np.zeros(4 * HIDDEN, np.float32),
                  "v": g(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}

    def emissions(self, cls):
        p = self.p
        x = p["e"][cls]
        h1, k1 = _lstm(x, p["w1"], p["u1"], p["b1"])
        h2, k2 = _lstm(x, p["w2"], p["u2"], p["b2"], True)
        h = np.concatenate([h1, h2], 2)
        return h @ p["v"] + p["c"], (x, h, k1, k2)

    def loss(self, cls, tags):
        """Mean negative log-likelihood of the CRF, and the gradients."""
        p, (n, t) = self.p, cls.shape
        em, (x, h, k1, k2) = self.emissions(cls)
        tr = p["t"]
        alpha, beta = np.zeros((n, t, TAGS), np.float32), np.zeros((n, t, TAGS), np.float32)
        alpha[:, 0] = em[:, 0]
        for k in range(1, t):
            alpha[:, k] = em[:, k] + _lse(alpha[:, k - 1, :, None] + tr, 1)
        for k in range(t - 2, -1, -1):
            beta[:, k] = _lse(tr + (em[:, k + 1] + beta[:, k + 1])[:, None], 2)
        z = _lse(alpha[:, -1], 1)
        rows, cols = np.arange(n)[:, None], np.arange(t)[None]
        gold = em[rows, cols, tags].sum(1) + tr[tags[:, :-1], tags[:, 1:]].sum(1)
        d_em = np.exp(alpha + beta - z[:, None, None])
        d_em[rows, cols, tags] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + tr + (em + beta)[:, 1:, None] - z[:, None, None, None])
        d_t = pair.sum((0, 1))
        np.add.at(d_t, (tags[:, :-1], tags[:, 1:]), -1)
        d_em /= n
        flat = d_em.reshape(-1, TAGS)
        d_h = d_em @ p["v"].T
        dx1, dw1, du1, db1 = _lstm_back(d_h[:, :, :HIDDEN], x, p["w1"], p["u1"], k1)
        dx2, dw2, du2, db2 = _lstm_back(d_h[:, :, HIDDEN:], x, p["w2"], p["u2"], k2, True)
        d_e = np.zeros_like(p["e"])
        np.add.at(d_e, cls, dx1 + dx2)
        return (z - gold).mean(), {"e": d_e, "w1": dw1, "u1": du1, "b1": db1, "w2": dw2, "u2": du2, "b2": db2, "v": h.reshape(-1, 2 * HIDDEN).T @ flat, "c": flat.sum(0), "t": d_t / n}

    def decode(self, cls):
        """Best tags by Viterbi and, for each position, by how much the best tag leads."""
        em, _ = self.emissions(cls)
        n, t, _ = em.shape
        score, back = em[:, 0], np.zeros((n, t, TAGS), np.int8)
        for k in range(1, t):
            both = score[:, :, None] + self.p["t"]
            back[:, k] = both.argmax(1)
            score = both.max(1) + em[:, k]
        tags = np.zeros((n, t), np.int64)
        tags[:, -1] = score.argmax(1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(n), k, tags[:, k]]
        return tags, em


def tags_of(length: int, spans) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a], out[a + 1:b] = k, k + 1
    return out


def made_up(n: int, seed: int = 11) -> list[tuple[str, list]]:
    """Labelled sentences: words, junk numbers and the four kinds in many surface forms."""
    r = np.random.default_rng(seed)
    pick = lambda x: x[r.integers(len(x))]
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda lo=2, hi=9: "".join(pick(letters) for _ in range(r.integers(lo, hi)))
    digits = lambda k: "".join(str(r.integers(10)) for _ in range(k))

    def value(kind):
        if kind == "email":
            sep = pick(["@", "@", " @ ", "(@)", " @", "@ "])
            return word() + pick(["", ".", "_", "-"]) + pick([word(), digits(2)]) + sep + word(3) + pick([".", ".", " . "]) + pick(["com", "org", "net", "de", "example.com"])
        if kind == "ip":
            return pick([".", ".", " . ", ". ", "[.]"]).join(str(r.integers(256)) for _ in range(4))
        if kind == "card":
            d = digits(15)
            d += next(c for c in "0123456789" if luhn(d + c))
            s = pick(["", " ", "-", ".", "/", "  ", " - "])
            return s.join(d[i:i + 4] for i in range(0, 16, 4))
        cc = pick(["+", "00", "", ""]) + str(r.integers(1, 99))
        s = pick([" ", "-", ".", "/"])
        return cc + s + pick(["(%s)", "%s"]) % digits(3) + s + digits(3) + s + digits(4)

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW - 44:
            x = r.random()
            if x < 0.1:
                kind = pick(KINDS)
                v = value(kind)
                lead = pick(["", "", ":", "("])
                spans.append((kind, len(text) + len(lead), len(text) + len(lead) + len(v)))
                text += lead + v + pick(["", "", ".", ",", ")"]) + " "
            elif x < 0.16:
                text += pick([digits(r.integers(1, 9)), digits(2) + "." + digits(2), digits(4) + "-" + digits(2) + "-" + digits(2), "@" + word(), "$" + digits(3), digits(24), word() + digits(3)]) + pick([" ", ". ", ", "])
            else:
                w = word()
                text += pick([w, w, w.capitalize(), w.upper()]) + pick([" ", " ", " ", ", ", ". ", "\n", "### ", " | "])
        out.append((text, spans))
    return out


def fit(examples: list[tuple[str, list]] | None = None, epochs: int = 6, seed: int = 7, batch: int = 48) -> Tagger:
    """Adam on windows of the labelled texts (text, [(kind, start, end)]); spans cut by a window are
    left out of it. examples are bounded by their caller; the made-up ones are 2,400."""
    examples = made_up(2400) if examples is None else examples
    cls, tags = [], []
    for text, spans in examples:
        whole = tags_of(len(text), spans)
        codes = classes_of(np.array([ord(c) for c in text], np.int64))
        for a in range(0, max(1, len(text) - WINDOW + STEP), STEP):
            c, t = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
            part = slice(a, min(a + WINDOW, len(text)))
            c[:part.stop - a], t[:part.stop - a] = codes[part], whole[part]
            cls.append(c)
            tags.append(t)
    cls, tags = np.array(cls), np.array(tags)
    net, r = Tagger(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-len(cls) // batch)
    for _ in range(epochs):
        order = r.permutation(len(cls))
        for i in range(0, len(order), batch):
            at = order[i:i + batch]
            _, grads = net.loss(cls[at], tags[at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


@functools.lru_cache(maxsize=4)
def default_tagger() -> Tagger:
    return fit()


def _holds(kind: str, value: str) -> bool:
    """The kind's own rule, which a proposed span must satisfy."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        return value.count("@") == 1 and "." in value.split("@")[1] and len(value) >= 6
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and value.count(".") == 3 and all(map(_small, parts))
    if re.search(r"[^0-9\s().+/\[\]-]", value):
        return False
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and bool(re.search(r"[^0-9]", value.strip()))


def _alone(text: str, a: int, b: int) -> bool:
    """No letter or digit stands right before or after the span."""
    return not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())


def proposals(net: Tagger, texts: list[str], chunk: int = 512):
    """Reconciled spans of the network for each text. Parts that neighbouring windows cut at their edges are joined;
    spans that one window holds go before those."""
    where, codes, known = [], [], set()

    def add(k: int, w: int):
        if (k, w) in known:
            return
        known.add((k, w))
        row = np.zeros(WINDOW, np.uint32)
        part = np.frombuffer(texts[k][w * STEP:w * STEP + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
        row[:len(part)] = part
        where.append((k, w))
        codes.append(row)

    for k, t in enumerate(texts):
        last = -1
        for m in TRIGGER.finditer(t):
            for w in range(max(last + 1, (m.start() - WINDOW) // STEP + 1, 0), m.start() // STEP + 1):
                add(k, w)
                last = w
    found: list[list] = [[] for _ in texts]
    lefts, rights, i = {}, {}, 0  # parts that a window cuts there; windows beside them are scored too
    while i < len(codes):
        rows = codes[i:i + chunk]
        tags, em = net.decode(classes_of(np.array(rows, np.int64)))
        lead = np.take_along_axis(em, tags[:, :, None], 2)[:, :, 0] - em.mean(2)
        begins = tags % 2 == 1
        begins[:, 0] |= tags[:, 0] > 0
        for r, j in zip(*np.nonzero(begins), strict=True):
            kind, e = tags[r, j] - 1 + tags[r, j] % 2, j + 1
            while e < WINDOW and tags[r, e] == kind + 1:
                e += 1
            k, w = where[i + r]
            start = w * STEP
            left, right = j < EDGE and start > 0, e > WINDOW - EDGE and start + WINDOW < len(texts[k])
            part = float(lead[r, j:e].mean()), start + int(j), min(start + int(e), len(texts[k]))
            if not left and not right:
                if tags[r, j] % 2:
                    found[k].append((False, -round(part[0], 3), *part[1:], KINDS[(kind - 1) // 2]))
                continue
            if left:
                lefts[k, w, kind] = (*part, right)
                add(k, w - 1)
            if right:
                if not left:
                    rights[k, w, kind] = part
                add(k, w + 1)
        i += len(rows)
    for (k, w, kind), (score, a, b) in rights.items():
        leads, on = [score], True
        while on and (more := lefts.get((k, w + 1, kind))) and a <= more[1] <= b:
            leads.append(more[0])
            w, b, on = w + 1, more[2], more[3]
        if not on:
            found[k].append((True, -round(sum(leads) / len(leads), 3), a, b, KINDS[(kind - 1) // 2]))
    out = []
    for k, t in enumerate(texts):
        kept: list[tuple[int, int, str]] = []
        for _, _, a, b, kind in sorted(set(found[k])):
            while b > a and t[b - 1].isspace():
                b -= 1
            while a < b and t[a].isspace():
                a += 1
            if a < b and TRIGGER.search(t, a, b) and _alone(t, a, b) and _holds(kind, t[a:b]):
                at = bisect_left(kept, (a, b, kind))
                if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                    kept.insert(at, (a, b, kind))
        out.append([(kind, a, b) for a, b, kind in kept])
    return out


def merged(base, more):
    """Base spans, and those of the network that touch none."""
    edges = sorted((a, b) for _, a, b in base)
    ends, top = [], 0
    for _, b in edges:
        top = max(top, b)
        ends.append(top)
    keep = []
    for kind, a, b in more:
        at = bisect_left(edges, (b, 0))
        if at == 0 or ends[at - 1] <= a:
            keep.append((kind, a, b))
    return in_order([*base, *keep])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, net: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs; a narrow map over Arrow batches, with the network's weights (a few
    tens of kB) broadcast. Extra columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast((net or default_tagger()).p)

    def run(batches):
        tagger = Tagger()
        tagger.p = shared.value
        for ids, texts in in_pieces(batches, ["doc_id", "text"]):
            texts = [t or "" for t in texts]
            rows = []
            for i, t, more in zip(ids, texts, proposals(tagger, texts), strict=True):
                base = in_order(base_spans(t))
                n = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((i, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(merged(base, more))))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)], names)

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, net: Tagger | None = None, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets, such as [email]; all other
    columns, and null texts, stay as they are. Overlapping spans are replaced as one, named after the first."""
    shared = docs.sparkSession.sparkContext.broadcast((net or default_tagger()).p)

    def run(batches):
        tagger = Tagger()
        tagger.p = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for (texts,) in in_pieces([batch], [text_col]):
                whole = [t or "" for t in texts]
                for t, raw, more in zip(whole, texts, proposals(tagger, whole), strict=True):
                    parts, last = [], 0
                    for kind, a, b in sorted(merged(base_spans(t), more), key=lambda s: (s[1], -s[2])):
                        if a >= last:
                            parts += [t[last:a], f"[{kind}]"]
                        last = max(last, b)
                    out.append(raw if not parts else "".join([*parts, t[last:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
