"""PII: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

The labelled spans come from a seeded generator that sets e-mail addresses, phone numbers, IP addresses, card numbers,
social security numbers, secrets, names and postal addresses, with their bounds, into invented text among words and
numbers that are none of these.

Every character of every document is read by the network. A text is cut into overlapping windows; many windows of many
documents step side by side, and a character's emissions come from the window in which it stands furthest from an end.
One Viterbi path over the whole document reconciles the windows. As almost all of a path is outside of any span, the
path is first bounded: a run of characters can be a span only if the most that its emissions and transitions can add
over staying outside isn't below zero. The bound needs one number a character, and the path is then decoded in the
stretches where it leaves anything open; elsewhere it is proven to be outside.
"""

from __future__ import annotations

import hashlib
import random
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel as K
from .shared import documents, shared_dir

KINDS = ("email", "phone", "ip", "card", "ssn", "secret", "name", "address")
LABELS = 1 + 2 * len(KINDS)  # 0 outside, then begin and inside of each kind
#: Size of a state and of a character's vector; characters of a window and those that it shares with the next; windows side by side.
HIDDEN, EMBED, WINDOW, OVERLAP, TOGETHER = 16, 8, 512, 48, 512
POOL, TRAIN_STEPS, TRAIN_WINDOW, BATCH, SEED, SLOPE, RATE, LOCAL = 2_000_000, 1800, 96, 112, 12, 0.25, 0.07, 0.5
SCHEMA = "doc_id long, n_spans int, spans array<struct<start:int,end:int,kind:string>>, text string"

_SYMBOLS = " \n\t" + string.ascii_letters + "0" + string.punctuation
_CODE = {c: i + 3 for i, c in enumerate(_SYMBOLS)}  # 0 other capital, 1 other letter, 2 anything else
N_CODES = len(_CODE) + 3


@lru_cache(1)
def _code_table() -> np.ndarray:
    table = np.full(len(K.lower_table()), 2, np.uint8)
    table[K.lower_table() != 0] = 1
    table[K.upper_table()] = 0
    for c, i in _CODE.items():
        table[ord(c)] = i
    table[48:58] = _CODE["0"]
    return table


# --- labelled spans -------------------------------------------------------------------------------------------------

_SYL = "an er in on the st re nd at en ed or es is it le de la que ción ment eau eux ung ich ver sch keit ou ai ñas é ö ü ll rr th wh sh".split()
_ONSET = "b c d f g h j k l m n p q r s t v w x y z b c d f g h l m n p r s t br ch cl cr dr fl fr gh gl gr kn ph pl pr qu sc sch sh sl sm sp st str th tr tz wh ñ ç pf zw".split() + [""] * 12
_VOWEL = "a e i o u a e i o u a e i o y ai au ea ee ei ie io oa oo ou ue é è ê à á í ó ú ü ö ä".split()
_CODA = "ck d ft g k l ll m mp n nd ng nt p r rd rs rt s sh ss st t th x z ß ch lt".split() + [""] * 20
_COMMON = "the and of to in a is that it for was with as on be at by this from or have not are but und der die das ist nicht mit ein eine von zu auf für de la le les et des en un une que qui dans pour pas el los las y del por con para no se lo su".split()


_GIVEN = "James Mary John Anna Robert Linda Michael Laura David Sarah Maria José Carlos Lucía Miguel Elena Jean Marie Pierre Claire Hans Greta Karl Ingrid Peter Eva Ahmed Fatima Wei Yuki Raj Priya Olga Ivan Tom Ann".split()
_FAMILY = "Smith Jones Brown Miller Davis García López Martínez Müller Schmidt Fischer Weber Dupont Moreau Laurent Rossi Novak Kowalski Nguyen Chen Tanaka Singh Patel Haddad Olsen Jansen O'Neill Baker Young Hall".split()
_STREET = "Street St. Avenue Ave. Road Rd. Lane Drive Boulevard Court".split()


def _word(r: random.Random) -> str:
    k = r.random()
    if k < 0.35:
        return "".join(r.choice(_SYL) for _ in range(r.randint(1, 4)))
    return "".join(r.choice(_ONSET) + r.choice(_VOWEL) + r.choice(_CODA) for _ in range(r.choice([1, 1, 2, 2, 2, 3, 3, 4])))


_OTHER = "日本語中文字한국어العربيةпривітмирγλώσσα" + "e\u0301" * 3  # letters that all have one code


def _foreign(r: random.Random) -> str:
    return "".join(r.choice(_OTHER) for _ in range(r.randint(1, 8)))


def _person(r: random.Random) -> str:
    given = r.choice(_GIVEN) if r.random() < 0.7 else _word(r).capitalize()
    family = r.choice(_FAMILY) if r.random() < 0.6 else _word(r).capitalize()
    return r.choice([f"{given} {family}", f"{given} {family}", f"{given} {family}", f"{given[0]}. {family}", family])


def _filler(r: random.Random, words: float, other: float) -> str:
    """A word or something with digits or an at sign that is no personal data."""
    if r.random() < words:
        w = _foreign(r) if r.random() < other else r.choice(_COMMON) if r.random() < 0.15 else _word(r)
        if r.random() < 0.04:
            w += _word(r) + _word(r)
        w = w.capitalize() if r.random() < 0.08 else w
        if r.random() < 0.02:
            return " ".join([w] * r.choice([2, 3, 5, 30]))
        return w + r.choice(["", "", "", "", "", ",", ".", ".", ";", ":", "?", "!"])
    d = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    month = r.randint(1, 12)
    return r.choice(
        [
            lambda: str(r.randint(0, 99)),
            lambda: str(r.randint(100, 99999)),
            lambda: d(r.randint(6, 9)),
            lambda: str(r.randint(1900, 2099)),
            lambda: f"{r.randint(0, 99)}.{r.randint(0, 99)}",
            lambda: f"{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
            lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
            lambda: f"{r.randint(1, 28)}/{month}/{r.randint(1990, 2030)}",
            lambda: f"{r.randint(1990, 2030)}-{month:02d}-{r.randint(1, 28):02d}",
            lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02d}",
            lambda: f"${r.randint(1, 999)},{d(3)}.{d(2)}",
            lambda: f"{r.randint(1, 100)}%",
            lambda: f"CC BY-NC {r.randint(1, 4)}.0.",
            lambda: f"{r.choice(['Apache License', 'General Public License', 'Mozilla Public License', 'the License'])}, {r.choice(['version', 'Version'])} {r.randint(1, 9)}{r.choice(['', '.0', '.1'])}.",
            lambda: f"page {r.randint(1, 400)}",
            lambda: f"{r.choice(['see', 'See', 'version', 'of', 'in', 'section', 'no.', 'page'])} {r.randint(1, r.choice([9, 99, 2099]))}{r.choice(['', '.', ','])}",
            lambda: f"version {r.randint(1, 9)} of {r.randint(1990, 2030)}, page {r.randint(1, 400)}",
            lambda: f"@ {_word(r)}",
            lambda: f"@{_word(r)}",
            lambda: f"{_word(r)}{r.randint(1, 99)}",
            lambda: f"{r.randint(1, 9)})",
            lambda: f"[{r.randint(1, 99)}]",
            lambda: f"{d(4)}/{d(4)}",
        ]
    )()


def _datum(r: random.Random) -> tuple[str, str, str, str]:
    """(before, span, after, kind)."""
    d = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    pick = lambda n, s: "".join(r.choice(s) for _ in range(n))
    kind = r.choice(KINDS)
    if kind == "email":
        user = r.choice([_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}.{d(2)}", f"{_word(r)}_{_word(r)}", f"{_word(r)}{d(r.randint(1, 4))}", f"{_word(r)[0]}.{_word(r)}", f"{_word(r)}+{_word(r)}"])
        host = r.choice([_word(r), f"mail{d(1)}.{r.choice(['example', _word(r)])}", f"{_word(r)}-{_word(r)}", f"{_word(r)}.{_word(r)}", "example"])
        user, host = (x.encode("ascii", "ignore").decode() or "ab" for x in (user, host))
        return "", f"{user}@{host}.{r.choice(['com', 'com', 'com', 'org', 'net', 'de', 'fr', 'io', 'co.uk', 'edu'])}", "", kind
    if kind == "phone":
        a, b, c = d(3), r.choice(["555", d(3)]), d(4)
        return "", r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}", f"+{r.randint(20, 99)} {d(3)} {d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+1{a}{b}{c}"]), "", kind
    if kind == "ip":
        return "", ".".join(str(r.randint(0, 255)) for _ in range(4)), "", kind
    if kind == "card":
        sep = r.choice(["", "", "", " ", "-"])
        return "", sep.join(d(4) for _ in range(4)) if r.random() < 0.9 else f"3{d(3)}{sep}{d(6)}{sep}{d(5)}", "", kind
    if kind == "ssn":
        return "", f"{d(3)}-{d(2)}-{d(4)}", "", kind
    if kind == "name":
        before, after = r.choice([(f"{t} ", "") for t in ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Madame", "Monsieur", "Señora")] + [("name: ", ""), ("Name: ", ""), ("my name is ", ""), ("Dear ", ","), ("Contact: ", "")])
        return before, _person(r), after, kind
    if kind == "address":
        n, w = r.randint(1, 9999), _word(r).capitalize()
        own = r.choice([f"{n} {w} {r.choice(_STREET)}", f"{n} {w} {r.choice(_STREET)}", f"{n % 300} rue {w}", f"{w}straße {n % 300}", f"Calle {w} {n % 300}"])
        return "", own + r.choice(["", "", f", {d(5)} {_word(r).capitalize()}"]), "", kind
    value = r.choice([lambda: pick(40, "0123456789abcdef"), lambda: pick(40, "0123456789abcdef"), lambda: pick(32, "0123456789abcdef"), lambda: "sk-" + pick(r.randint(20, 40), string.ascii_letters + string.digits), lambda: "AKIA" + pick(16, string.ascii_uppercase + string.digits), lambda: "ghp_" + pick(36, string.ascii_letters + string.digits), lambda: pick(r.randint(20, 40), string.ascii_letters + string.digits), lambda: pick(r.randint(20, 40), string.ascii_letters), lambda: pick(r.randint(20, 40), string.ascii_lowercase)])()
    name = r.choice(["token", "token", "api_key", "secret", "password", "key", "API_KEY", "access_token", "auth"])
    cues = [(f'{name} = "', '"'), (f'{name} = "', '"'), (f"{name}: ", ""), (f"{name}='", "'"), (f"{name}=", "")]
    before, after = r.choice(cues if value.isalpha() else [*cues, ("", "")])  # letters alone are a secret only where something says so
    return before, value, after, kind


def labelled(r: random.Random, length: int) -> tuple[str, list[tuple[int, int, str]]]:
    """Invented text of about this length and the spans of personal data in it."""
    out, spans, size = [], [], 0
    junk = r.choice(["", "", "", "", "sym", "!!", "|"])
    again = low = False  # data stand next to each other more often than by chance; no capital follows a name or address at once
    often, words, other = r.choice([0.13, 0.13, 0.03, 0.0]), r.choice([0.72, 0.9, 0.98]), r.choice([0.01] * 9 + [0.9])
    begins = True
    while size < length:
        if again or r.random() < often:
            again = r.random() < 0.35
            before, value, after, kind = _datum(r)
            spans.append((size + len(before), size + len(before) + len(value), kind))
            piece, low = before + value + after, kind in ("name", "address")
            if r.random() < 0.25:
                piece += r.choice([".", ",", ";", ")", "?"])
        else:
            piece = _filler(r, words, other)
            if low:
                piece = piece[:1].lower() + piece[1:]
            elif begins and r.random() < 0.9:
                piece = piece[:1].upper() + piece[1:]
            begins, low = piece[-1] in ".?!", False
        if junk == "sym":
            piece += r.choice(["###", "$$$", "%%%", "&&&", "***", ""])
        elif junk == "!!":
            piece += "!!"
        elif junk == "|":
            piece += " |"
        piece += r.choice([" ", " ", " ", " ", " ", " ", " ", "\n"])
        out.append(piece)
        size += len(piece)
    text = "".join(out)
    return (text.upper() if junk == "!!" and len(text.upper()) == len(text) else text), spans




def corpus(r: random.Random, size: int = POOL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and labels of generated texts of various lengths, end to end, and the places of blanks outside of spans."""
    texts, labels, total = [], [], 0
    while total < size:
        text, spans = labelled(r, r.randint(40, 800))
        y = np.zeros(len(text), np.int64)
        for s, e, kind in spans:
            y[s], y[s + 1 : e] = 1 + 2 * KINDS.index(kind), 2 + 2 * KINDS.index(kind)
        texts.append(text)
        labels.append(y)
        total += len(text)
    codes, y = _code_table()[K.codes(["".join(texts)])[0][:-1]].astype(np.int64), np.concatenate(labels)
    return codes, y, np.flatnonzero(((codes == _CODE[" "]) | (codes == _CODE["\n"])) & (y == 0))


def training_batch(r: random.Random, n: int, pool: tuple[np.ndarray, np.ndarray, np.ndarray], length: int = TRAIN_WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the generated texts that end at random blanks, and their labels. None ends within a span, as no document does."""
    blanks = pool[2][np.searchsorted(pool[2], length) :]
    at = np.array([blanks[r.randrange(len(blanks))] - length for _ in range(n)])[:, None] + np.arange(length)
    return pool[0][at], pool[1][at]


# --- the network ----------------------------------------------------------------------------------------------------


def allowed() -> np.ndarray:
    """0 for transitions that spans can have, a large negative number for an inside label after anything but its own kind."""
    t = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        b, i = 1 + 2 * k, 2 + 2 * k
        t[:, i] = -1e4
        t[[b, i], i] = 0
    return t


def initial(seed: int = SEED) -> dict[str, np.ndarray]:
    """Gates are clipped to 0..1 (a hard sigmoid) and ordered in, forget, out, candidate; x / (1 + |x|) stands for the hyperbolic tangent. A state's inputs are the state before, the character's vector and a constant."""
    g = np.random.default_rng(seed)
    h, e = HIDDEN, EMBED
    p = {"emb": g.normal(0, 1, (e, N_CODES)), "w": g.normal(0, 1 / np.sqrt(h + e), (2, 4 * h, h + e + 1)), "e": g.normal(0, 0.2, (2, LABELS, h)), "o": np.zeros((LABELS, 1)), "t": np.zeros((LABELS, LABELS))}
    p["w"][:, :, -1] = 0
    p["w"][:, : 3 * h, -1] = 0.5 / SLOPE
    p["w"][:, h : 2 * h, -1] = 0.8 / SLOPE  # remember by default
    return p


_clip = np.clip if not hasattr(np, "_core") else np._core.umath.clip  # without the checks of its wrapper, which cost more than the work


def sloped(w: np.ndarray) -> np.ndarray:
    """Weights with the slope of the gates' clipped line in them."""
    return np.concatenate([w[:, : 3 * HIDDEN] * w.dtype.type(SLOPE), w[:, 3 * HIDDEN :]], 1)


def _squashed(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Steps:
    """Both directions of the network over windows of a flat array of codes, stepping through time together.

    Windows stand from long to short, so those that go on are always the first. Arrays have a row a feature and a column
    a window. Direction 0 reads a window from its start, direction 1 from its end.
    """

    def __init__(self, p: dict[str, np.ndarray], codes: np.ndarray, start: np.ndarray, size: np.ndarray, keep: bool = False) -> None:
        n, t, h, dt = len(start), int(size[0]), HIDDEN, p["w"].dtype
        live = n - np.searchsorted(size[::-1], np.arange(t), "right")
        self.size, self.longest = size, t
        # By character: what direction 0 knew there, a constant, and what direction 1 knew (windows of one size) or knew that many steps from its start (others).
        self.even = int(size[-1]) == t
        self.hs = np.zeros((t, 2 * h + 1, n), dt)
        self.hs[:, h] = 1
        z, a, c, v, d = np.zeros((2, h + EMBED + 1, n), dt), np.empty((2, 4 * h, n), dt), np.zeros((2, h, n), dt), np.empty((2, h, n), dt), np.empty((2, h, n), dt)
        z[:, -1] = 1
        none, one = dt.type(0), dt.type(1)
        emb, w = p["emb"], sloped(p["w"])
        first, last = start.copy(), start + size - 1
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, m in enumerate(live.tolist()):
            if m < z.shape[2]:
                z, a, c, v, d, first, last = (x[..., :m] for x in (z, a, c, v, d, first, last))
            gates, u = a[:, : 3 * h], a[:, 3 * h :]
            emb.take(codes.take(first), 1, out=z[0, h:-1], mode="clip")
            emb.take(codes.take(last), 1, out=z[1, h:-1], mode="clip")
            np.matmul(w, z, out=a)
            _clip(gates, none, one, out=gates)
            np.abs(u, out=d)
            d += one
            u /= d
            if keep:
                self.kept.append((z.copy(), a.copy(), c.copy()))
            c *= gates[:, h : 2 * h]
            np.multiply(gates[:, :h], u, out=v)
            c += v
            np.abs(c, out=d)
            d += one
            np.divide(c, d, out=v)
            np.multiply(gates[:, 2 * h :], v, out=z[:, :h])
            self.hs[k, :h, :m] = z[0, :h]
            self.hs[t - 1 - k if self.even else k, h + 1 :, :m] = z[1, :h]
            first += 1
            last -= 1

    def emissions(self, p: dict[str, np.ndarray], lo: int, hi: int) -> np.ndarray:
        """(characters lo to hi of each window, labels, windows); what lies beyond a window's end has no meaning."""
        w, h = np.concatenate([p["e"][0], p["o"], p["e"][1]], 1), HIDDEN
        if self.even:
            return np.matmul(w, self.hs[lo:hi])
        at = np.maximum(self.size - 1 - np.arange(lo, hi)[:, None], 0)
        out = np.matmul(w[:, : h + 1], self.hs[lo:hi, : h + 1])
        out += np.matmul(w[:, h + 1 :], self.hs[at, h + 1 :, np.arange(len(self.size))].transpose(0, 2, 1))
        return out


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss per character and its gradient, by forward-backward and back-propagation.

    The loss is the negative log likelihood of the labels, and LOCAL times that of each label by its emissions alone.
    Without the second part emissions are free wherever transitions decide, and the decoder's bounds exclude little.
    """
    n, t = x.shape
    h = HIDDEN
    net = Steps(p, x.ravel(), np.arange(n) * t, np.full(n, t), keep=True)
    em_t = net.emissions(p, 0, t).transpose(0, 2, 1).astype(float)
    # Forward-backward on probabilities, scaled to one at every character, in double precision.
    trans = p["t"].astype(float) + allowed()
    m = np.exp(trans)
    top = em_t.max(-1, keepdims=True)
    e = np.exp(em_t - top)
    fw, bw, c = np.empty((t, n, LABELS)), np.ones((t, n, LABELS)), np.empty((t, n, 1))
    for k in range(t):
        v = (fw[k - 1] @ m) * e[k] if k else e[0]
        c[k] = v.sum(-1, keepdims=True)
        fw[k] = v / c[k]
    for k in range(t - 2, -1, -1):
        bw[k] = ((e[k + 1] * bw[k + 1]) @ m.T) / c[k + 1]
    z = (np.log(c) + top).sum(0)[:, 0]
    rows = np.arange(n)
    gold = em_t[np.arange(t), rows[:, None], y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
    scale = 1 / (n * t)
    d_em = fw * bw
    d_t = m * (fw[:-1].reshape(-1, LABELS).T @ (e[1:] * bw[1:] / c[1:]).reshape(-1, LABELS))
    alone = e / e.sum(-1, keepdims=True)
    local = -np.log(alone[np.arange(t)[:, None], rows, y.T]).mean()
    d_em += LOCAL * alone
    d_em[np.arange(t)[:, None], rows, y.T] -= 1 + LOCAL
    dt = p["w"].dtype
    d_em = np.ascontiguousarray((d_em * scale).astype(dt).transpose(0, 2, 1))  # time, labels, windows
    d_t -= np.bincount((y[:, :-1] * LABELS + y[:, 1:]).ravel(), minlength=LABELS * LABELS).reshape(LABELS, LABELS)
    both = np.stack([d_em, d_em[::-1]], 1)  # in each direction's own order of time
    g = {"o": d_em.sum((0, 2))[:, None], "t": (d_t * scale).astype(dt), "w": np.zeros_like(p["w"]), "emb": np.zeros_like(p["emb"])}
    hs = np.stack([net.hs[:, :h], net.hs[::-1, h + 1 :]], 1)
    g["e"] = np.matmul(both, hs.transpose(0, 1, 3, 2)).sum(0)
    d_dir = np.matmul(p["e"].transpose(0, 2, 1), both)
    dh, dc, d_pre = np.zeros((2, h, n), dt), np.zeros((2, h, n), dt), np.empty((2, 4 * h, n), dt)
    d_x = np.empty((t, 2, EMBED, n), dt)
    back = sloped(p["w"]).transpose(0, 2, 1)
    for k in range(t - 1, -1, -1):
        own, a, before = net.kept[k]
        i, f, o, u = (a[:, j * h : (j + 1) * h] for j in range(4))
        v = _squashed(before * f + i * u)
        dh = dh + d_dir[k]
        dc = dc + dh * o * (1 - np.abs(v)) ** 2
        d_pre[:, :h], d_pre[:, h : 2 * h], d_pre[:, 2 * h : 3 * h] = dc * u, dc * before, dh * v
        d_pre[:, : 3 * h] *= (a[:, : 3 * h] > 0) & (a[:, : 3 * h] < 1)
        d_pre[:, 3 * h :] = dc * i * (1 - np.abs(u)) ** 2
        g["w"] += np.matmul(d_pre, own.transpose(0, 2, 1))
        d_z = np.matmul(back, d_pre)
        dh, d_x[k] = d_z[:, :h], d_z[:, h:-1]
        dc = dc * f
    g["w"] = sloped(g["w"])
    codes = np.stack([x.T, x[:, ::-1].T], 1).ravel()
    for j in range(EMBED):
        g["emb"][j] = np.bincount(codes, d_x[:, :, j].ravel(), N_CODES)
    return float((z - gold).mean() / t + LOCAL * local), g


@lru_cache(2)
def train(steps: int = TRAIN_STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Parameters after Adam on generated windows; the same for the same arguments, whatever the documents."""
    p = {k: v.astype(np.float32) for k, v in initial(seed).items()}
    r = random.Random(seed)
    pool = corpus(r)
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, steps + 1):
        _, g = gradients(p, *training_batch(r, BATCH, pool))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * min(1, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / (steps + 1)))
        for k, v in g.items():
            v = v * np.float32(min(1, 5 / norm))
            a, b = m[k]
            a += 0.1 * (v - a)
            b += 0.01 * (v * v - b)
            p[k] -= np.float32(rate) * (a / np.float32(1 - 0.9**step)) / (np.sqrt(b / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return p


def weights(spark: SparkSession) -> dict[str, np.ndarray]:
    """The trained parameters: read from the shared folder if a session trained them before with the same settings, else trained and put there."""
    with open(__file__, "rb") as own:
        made_by = hashlib.sha256(own.read()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/pii-weights-{made_by}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        rows = spark.read.parquet(path).collect()  # one row a parameter
        return {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in rows}
    p = train()
    rows = [(k, list(v.shape), bytearray(v.tobytes())) for k, v in p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)
    return p


# --- decoding -------------------------------------------------------------------------------------------------------


class Windows:
    """Windows of a run of texts, from long to short: start and size in cp, and the characters [lo, hi) of each for which it speaks."""

    def __init__(self, at: np.ndarray) -> None:
        size = np.diff(at) - 1
        step = WINDOW - OVERLAP
        per = np.where(size > 0, np.maximum(0, -(-(size - WINDOW) // step)) + 1, 0)
        doc = np.repeat(np.arange(len(size)), per)
        offset = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * step
        own = np.minimum(WINDOW, size[doc] - offset)
        lo = np.where(offset > 0, OVERLAP // 2, 0)
        hi = np.where(offset + own < size[doc], own - OVERLAP // 2, own)
        order = np.argsort(-own, kind="stable")
        self.start, self.size, self.lo, self.hi = (at[:-1][doc] + offset)[order], own[order], lo[order], hi[order]

    def batches(self, chosen: np.ndarray) -> Iterator[np.ndarray]:
        """Windows to step through together; those of full size stay among themselves."""
        full = int(np.searchsorted(-self.size[chosen], -WINDOW, "right"))
        for part in (chosen[:full], chosen[full:]):
            for i in range(0, len(part), TOGETHER):
                yield part[i : i + TOGETHER]


class Decoder:
    """The trained network with the transitions of the CRF, and the bounds that these put on any span."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p = p
        self.trans = (p["t"] + allowed()).astype(np.float32)
        rest = self.trans[0, 0]
        self.enter = np.maximum(0, self.trans[:, 1:].max(0) - rest)[:, None]  # the most that coming to a label adds
        self.leave = float(max(0, (self.trans[1:, 0] - rest).max()))

    def gain(self, codes: np.ndarray, windows: Windows) -> np.ndarray:
        """For every character the most that any label adds over outside; 0 between texts."""
        out = np.zeros(len(codes), np.float32)
        p = self.p | {"e": self.p["e"][:, 1:] - self.p["e"][:, :1], "o": self.p["o"][1:] - self.p["o"][0] + self.enter}
        for b in windows.batches(np.arange(len(windows.size))):
            net = Steps(p, codes, windows.start[b], windows.size[b])
            best = np.concatenate([net.emissions(p, k, min(k + 32, net.longest)).max(1) for k in range(0, net.longest, 32)]).T.copy()
            for row, start, lo, hi in zip(best, windows.start[b].tolist(), windows.lo[b].tolist(), windows.hi[b].tolist(), strict=True):
                out[start + lo : start + hi] = row[lo:hi]
        return out

    def open_stretches(self, gain: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the stretches outside of which no character can be in a span: around each other one, every run loses against outside."""
        gain = gain.astype(float)
        gain[at[1:] - 1] = -np.maximum(gain, 0).sum() - 1  # no run can make up for the end of its text
        total = np.concatenate([[0.0], np.cumsum(gain)])
        before = np.minimum.accumulate(total[:-1])
        after = np.maximum.accumulate(total[:0:-1])[::-1]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (after - before + self.leave > -0.01).view(np.int8), [0]])))
        return edge[::2], edge[1::2]

    def emissions(self, codes: np.ndarray, windows: Windows, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Emissions of all characters of the stretches, end to end."""
        base = np.concatenate([[0], np.cumsum(ends - starts)])
        out = np.empty((base[-1], LABELS), np.float32)
        at = np.full(len(codes), -1, np.int64)
        at[np.repeat(starts - base[:-1], ends - starts) + np.arange(base[-1])] = np.arange(base[-1])
        inside = np.concatenate([[0], np.cumsum(at >= 0)])
        needed = np.flatnonzero(inside[windows.start + windows.hi] > inside[windows.start + windows.lo])
        for b in windows.batches(needed):
            start, size, lo, hi = windows.start[b], windows.size[b], windows.lo[b], windows.hi[b]
            net = Steps(self.p, codes, start, size)
            for k in range(0, net.longest, 32):
                place = np.arange(k, min(k + 32, net.longest))[:, None]
                own = (place >= lo) & (place < hi)
                own &= at[np.minimum(start + place, len(codes) - 1)] >= 0
                row, col = np.nonzero(own)
                if len(row):
                    out[at[start[col] + k + row]] = net.emissions(self.p, k, k + len(place))[row, :, col]
        return out

    def paths(self, em: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Labels of all characters of the stretches, end to end: Viterbi, with outside (or a text's end) on either side."""
        size = ends - starts
        base = np.concatenate([[0], np.cumsum(size)])
        em = em.copy()
        opens = np.isin(starts, at)
        first = np.where(np.arange(LABELS) % 2, 0, -1e4).astype(np.float32)
        first[0] = 0
        em[base[:-1]] += np.where(opens[:, None], first, self.trans[0])
        em[base[1:] - 1] += np.where(np.isin(ends + 1, at)[:, None], 0, self.trans[:, 0])
        out = np.empty(base[-1], np.int64)
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):  # stretches of like length together, as much padded room as about 200,000 characters take
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= 200_000 and size[order[hi]] <= 2 * size[order[lo]] + 8:
                hi += 1
            own = order[lo:hi]
            if len(own) == 1:
                out[base[own[0]] : base[own[0] + 1]] = _viterbi_one(em[base[own[0]] : base[own[0] + 1]], self.trans)
            else:
                place = np.arange(int(size[own].max()))
                path = _viterbi(em[np.minimum(base[own][:, None] + place, base[-1] - 1)], self.trans, size[own])
                real = place < size[own][:, None]
                out[(base[own][:, None] + place)[real]] = path[real]
            lo = hi
        return out


def _viterbi(em: np.ndarray, trans: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best labels of many stretches at once; em is padded to the longest, and padding copies scores along."""
    n, t, _ = em.shape
    score = em[:, 0].copy()
    back = np.empty((t, n, LABELS), np.int8)
    still = np.arange(LABELS, dtype=np.int8)
    for k in range(1, t):
        s = score[:, :, None] + trans
        best = s.argmax(1)
        live = (k < size)[:, None]
        back[k] = np.where(live, best, still)
        score = np.where(live, np.take_along_axis(s, best[:, None, :], 1)[:, 0] + em[:, k], score)
    path = np.empty((n, t), np.int64)
    path[:, -1] = score.argmax(1)
    rows = np.arange(n)
    for k in range(t - 1, 0, -1):
        path[:, k - 1] = back[k, rows, path[:, k]]
    return path


def _viterbi_one(em: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The same for one stretch, however long, at a few operations a character."""
    score, flat, own = em[0], np.ascontiguousarray(trans.T), np.arange(LABELS)
    back = np.empty(em.shape, np.int8)
    for k in range(1, len(em)):
        s = flat + score
        best = s.argmax(1)
        back[k] = best
        score = s[own, best] + em[k]
    path = np.empty(len(em), np.int64)
    path[-1] = score.argmax()
    for k in range(len(em) - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def find(texts: list[str], decoder: Decoder) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of personal data in every text, in order."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    cp, at = K.codes(texts)
    codes, windows = _code_table()[cp].astype(np.int64), Windows(at)
    starts, ends = decoder.open_stretches(decoder.gain(codes, windows), at)
    if not len(starts):
        return out
    labels = np.zeros(len(codes), np.int64)
    inside = np.repeat(ends - np.cumsum(ends - starts), ends - starts) + np.arange((ends - starts).sum())
    labels[inside] = decoder.paths(decoder.emissions(codes, windows, starts, ends), starts, ends, at)
    begin = np.flatnonzero(labels % 2 == 1)
    doc = np.searchsorted(at, begin, "right") - 1
    more = (labels > 0) & (labels % 2 == 0)
    stop = np.flatnonzero(np.append(~more, True))
    end = stop[np.searchsorted(stop, begin, "right")]
    for d, b, e, k in zip(doc.tolist(), begin.tolist(), end.tolist(), labels[begin].tolist(), strict=True):
        out[d].append((b - int(at[d]), e - int(at[d]), KINDS[k // 2]))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for s, e, kind in spans:
        out += [text[last:s], f"[{kind.upper()}]"]
        last = e
    return "".join([*out, text[last:]])


def detect(docs: DataFrame) -> DataFrame:
    """Documents with personal data: doc_id, n_spans, spans (character offsets and kind), text with each span replaced by its kind.

    Documents without any have no row, nor have rows without an id and null or empty texts. A text of any length is read
    whole, and its memory is a number a character. Of equally good labellings the one with the lower label first wins.
    Repeated rows give repeated rows; an empty table gives none; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch, texts in K.chunks(batches):
            found = find(texts, decoder)
            rows = [i for i, s in enumerate(found) if s]
            spans = pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in found[i]] for i in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))
            yield K.batch_of(doc_id=batch.column("doc_id").take(pa.array(rows, pa.int64())), n_spans=pa.array([len(found[i]) for i in rows], pa.int32()), spans=spans, text=pa.array([redact(texts[i], found[i]) for i in rows], pa.string()))

    return documents(docs).mapInArrow(run, SCHEMA)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with personal data replaced by its kind and n_chars (where there is one) that of the new text.

    Null and empty texts stay as they are, as do all other columns and rows without an id; repeated rows are treated
    alike; an empty table gives none.
    """
    shared = spark.sparkContext.broadcast(weights(spark))
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch, texts in K.chunks(batches):
            found = find(texts, decoder)
            new = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            at = batch.schema.get_field_index("text")
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            batch = batch.set_column(at, "text", pa.array(new, batch.schema.field(at).type, mask=null))
            size = batch.schema.get_field_index("n_chars")
            if size >= 0:
                old = batch.column(size).to_pylist()
                batch = batch.set_column(size, "n_chars", pa.array([len(t) if s else n for t, s, n in zip(new, found, old, strict=True)], batch.schema.field(size).type))
            yield batch

    return docs.mapInArrow(run, fields)
