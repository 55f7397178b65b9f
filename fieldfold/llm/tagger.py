"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, decoding, and its labelled spans."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tag 0 is outside; kind k begins with 2k + 1 and goes on with 2k + 2.
TAGS = 2 * len(KINDS) + 1
HIDDEN = 8

_OWN = "@.-_+%() \n:/\"=,'|!?#&$*<>;[]{}~^`\\"
_CLASSES = {c: i + 4 for i, c in enumerate(_OWN)}
N_CLASSES = len(_OWN) + 4
_TABLE = np.zeros(0x3000, np.uint8)
for _c in range(len(_TABLE)):
    _s = chr(_c)
    _TABLE[_c] = _CLASSES.get(_s, 1 if "0" <= _s <= "9" else 2 if _s.isupper() else 3 if _s.isalpha() else 9 if _s.isspace() else 0)
#: Transitions that a tag sequence may make: a kind goes on only after it began.
ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])
BEGIN = np.array([t == 0 or t % 2 == 1 for t in range(TAGS)])
_NO = -1e4


def classes(text: str) -> np.ndarray:
    """The class of each code point: digit, upper case, letter, one for each common mark, other."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(code, len(_TABLE) - 1)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    def __init__(self, seed: int = 3, hidden: int = HIDDEN):
        r, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {"wo": r.normal(0, 0.2, (2 * h, TAGS)), "bo": np.zeros(TAGS), "tr": np.zeros((TAGS, TAGS)), "st": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"wx{d}": r.normal(0, 0.3, (N_CLASSES, 4 * h)), f"wh{d}": r.normal(0, 0.25, (h, 4 * h)), f"b{d}": np.concatenate([np.ones(h), np.zeros(3 * h)])}

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x: (time, batch) classes. Gates in the order forget, in, out, new."""
        p, h = self.p, self.h
        n, b = x.shape
        hs, cs = np.zeros((n + 1, b, h)), np.zeros((n + 1, b, h))
        gates = np.zeros((n, b, 4 * h)) if keep else None
        table = p[f"wx{d}"] + p[f"b{d}"]
        for t in range(n):
            z = table[x[t]] + hs[t] @ p[f"wh{d}"]
            g = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            cs[t + 1] = g[:, :h] * cs[t] + g[:, h : 2 * h] * new
            hs[t + 1] = g[:, 2 * h :] * np.tanh(cs[t + 1])
            if keep:
                gates[t] = np.concatenate([g, new], 1)
        return hs, cs, gates

    def scores(self, x: np.ndarray, keep: bool = False):
        """Emission scores (time, batch, tags) for classes (time, batch)."""
        f, b = self._lstm(x, "f", keep), self._lstm(x[::-1], "b", keep)
        both = np.concatenate([f[0][1:], b[0][1:][::-1]], 2)
        out = both @ self.p["wo"] + self.p["bo"]
        return (out, both, f, b) if keep else out

    def _lstm_back(self, x, d, state, dh_out, grads):
        hs, cs, gates = state
        h, (n, b) = self.h, x.shape
        dh, dc = np.zeros((b, h)), np.zeros((b, h))
        for t in range(n - 1, -1, -1):
            f, i, o, g = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
            dh = dh + dh_out[t]
            tc = np.tanh(cs[t + 1])
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * cs[t] * f * (1 - f), dc * g * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grads[f"wh{d}"] += hs[t].T @ dz
            grads[f"b{d}"] += dz.sum(0)
            np.add.at(grads[f"wx{d}"], x[t], dz)
            dh, dc = dz @ self.p[f"wh{d}"].T, dc * f

    def _moves(self):
        return np.where(ALLOWED, self.p["tr"], _NO), np.where(BEGIN, self.p["st"], _NO)

    def loss(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood of tags y and its gradients; x, y: (time, batch)."""
        e, both, f, bk = self.scores(x, True)
        n, b, k = e.shape
        tr, st = self._moves()
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        al, be = np.zeros((n, b, k)), np.zeros((n, b, k))
        al[0] = st + e[0]
        for t in range(1, n):
            al[t] = lse(al[t - 1][:, :, None] + tr, 1) + e[t]
        for t in range(n - 2, -1, -1):
            be[t] = lse(tr + (e[t + 1] + be[t + 1])[:, None, :], 2)
        z = lse(al[-1], 1)
        rows = np.arange(b)
        gold = st[y[0]] + e[0, rows, y[0]] + sum(tr[y[t - 1], y[t]] + e[t, rows, y[t]] for t in range(1, n))
        de = np.exp(al + be - z[:, None])
        g = {name: np.zeros_like(v) for name, v in self.p.items()}
        g["st"] = de[0].sum(0)
        for t in range(1, n):
            g["tr"] += np.exp(al[t - 1][:, :, None] + tr + (e[t] + be[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(g["tr"], (y[t - 1], y[t]), -1)
        np.add.at(g["st"], y[0], -1)
        for t in range(n):
            de[t, rows, y[t]] -= 1
        g["wo"], g["bo"] = np.einsum("tbi,tbk->ik", both, de), de.sum((0, 1))
        dh = de @ self.p["wo"].T
        self._lstm_back(x, "f", f, dh[:, :, : self.h], g)
        self._lstm_back(x[::-1], "b", bk, dh[::-1, :, self.h :], g)
        return (z - gold).mean() / n, {name: v / (b * n) for name, v in g.items()}

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        """scores() for decoding alone, as (time, tags, batch): one tanh a step for all gates, as
        sigmoid(z) = (1 + tanh(z / 2)) / 2."""
        h, (n, b) = self.h, x.shape
        kind = self.p["wo"].dtype
        half = np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(kind)
        out = np.empty((n, TAGS, b), kind)
        out[:] = self.p["bo"][:, None]
        for d, steps, wo in (("f", range(n), self.p["wo"][:h]), ("b", range(n - 1, -1, -1), self.p["wo"][h:])):
            table, wh, wo = (self.p[f"wx{d}"] + self.p[f"b{d}"]) * half, self.p[f"wh{d}"] * half, np.ascontiguousarray(wo.T)
            hs, cs = np.zeros((b, h), kind), np.zeros((b, h), kind)
            for t in steps:
                z = table[x[t]]
                z += hs @ wh
                np.tanh(z, out=z)
                gates = z[:, : 3 * h]
                gates += 1
                gates *= 0.5
                cs *= z[:, :h]
                cs += z[:, h : 2 * h] * z[:, 3 * h :]
                np.tanh(cs, out=hs)
                hs *= z[:, 2 * h : 3 * h]
                out[t] += wo @ hs.T
        return out

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (time, batch) for classes, and the emission margins over outside.

        Where no span can gain anything over staying outside, whatever stands around it, the best path is outside
        throughout, and isn't searched for."""
        every = self._emissions(x)
        n, k, b = every.shape
        tr, st = self._moves()
        # how much a span of each kind that has come to a step gains at most over outside: by emissions, and by the best
        # transition into each of its tags
        into = (tr - tr[0, 0]).max(0).astype(every.dtype)[:, None]
        start = (st - st[0]).astype(every.dtype)[:, None]
        top = span = every[0, 1::2] - every[0, :1] + np.maximum(start, into)[1::2]
        for t in range(1, n):
            outside = every[t, :1]
            span = span + (every[t, 2::2] - outside + into[2::2])
            np.maximum(span, every[t, 1::2] - outside + into[1::2], out=span)
            top = np.maximum(top, span)
        back = max(0.0, float((tr[:, 0] - tr[0, 0]).max()))
        open_ = np.flatnonzero((top >= -back).any(0))
        y, margin = np.zeros((n, b), np.int8), np.zeros((n, b), every.dtype)
        if not len(open_):
            return y, margin
        e = every[:, :, open_]
        best = np.empty_like(e)
        best[0] = st[:, None] + e[0]
        moves, via = tr.astype(e.dtype)[:, :, None], np.empty_like(e[0])
        for t in range(1, n):
            now, last = best[t], best[t - 1]
            np.add(last[0], moves[0], out=now)
            for a in range(1, k):
                np.add(last[a], moves[a], out=via)
                np.maximum(now, via, out=now)
            now += e[t]
        path = np.zeros((n, len(open_)), np.int64)
        path[-1] = best[-1].argmax(0)
        for t in range(n - 1, 0, -1):  # the step before is worked out again along the path alone
            path[t - 1] = (best[t - 1] + tr[:, path[t]]).argmax(0)
        y[:, open_] = path
        margin[:, open_] = np.take_along_axis(e, path[:, None, :], 1)[:, 0] - e[:, 0]
        return y, margin


def _luhn_digit(digits: list[int]) -> int:
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def labelled(count: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts with labelled spans: classes and tags, both (time, count), and the texts. Beside personal data they
    hold what looks like it: hex tokens, versions, dates, amounts, times and plain numbers."""
    r = np.random.default_rng(seed)
    pick = lambda options: options[int(r.integers(len(options)))]
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    letters = lambda a, b, alphabet="abcdefghijklmnopqrstuvwxyzéèñüß": "".join(alphabet[i] for i in r.integers(0, len(alphabet), int(r.integers(a, b))))
    ascii_ = "abcdefghijklmnopqrstuvwxyz"

    def email():
        local = letters(2, 9, ascii_) + pick(["", ".", "_", "-", "+"]) + pick(["", digits(int(r.integers(1, 4))), letters(1, 8, ascii_)])
        return f"{local.rstrip('.')}@{letters(2, 9, ascii_)}{pick(['', digits(1)])}.{pick(['example.com', 'com', 'org', 'net', 'co.uk', letters(2, 4, ascii_)])}"

    def ip():
        return ".".join(str(int(r.integers(0, 256))) for _ in range(4))

    def card():
        d = [int(c) for c in digits(int(pick([11, 13, 14, 15, 15, 15, 15, 17])))]
        s = "".join(map(str, d)) + str(_luhn_digit(d))
        cut = pick(["", "", " ", "-"])
        return cut.join(s[i : i + 4] for i in range(0, len(s), 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        own = pick([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])
        return pick([f"+{digits(int(r.integers(1, 3)))} ", "+1 ", "+1-", "", ""]) + own

    def other():
        return pick([
            lambda: "".join("0123456789abcdef"[i] for i in r.integers(0, 16, int(r.integers(8, 41)))), lambda: f"{r.integers(0, 20)}.{r.integers(0, 20)}", lambda: f"v{r.integers(0, 9)}.{r.integers(0, 30)}.{r.integers(0, 30)}",
            lambda: f"{r.integers(1900, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}", lambda: f"{r.integers(1, 29)}.{r.integers(1, 13)}.{r.integers(1950, 2030)}", lambda: digits(int(r.integers(1, 7))),
            lambda: f"${r.integers(1, 999)},{digits(3)}.{digits(2)}", lambda: f"{r.integers(0, 24)}:{digits(2)}", lambda: f"@{letters(3, 9, ascii_)}", lambda: f"{digits(2)}%", lambda: f"{digits(3)}-{digits(4)}", lambda: f"AKIA{digits(4)}{letters(6, 12, 'ABCDEFGHIJKLMNOP')}",
        ])()

    makers = [email, ip, card, phone]
    xs, ys, texts = np.zeros((length, count), np.uint8), np.zeros((length, count), np.int8), []
    for col in range(count):
        text, tags = "", []
        skip, follow = int(r.integers(0, 40)), None
        while len(text) < length + skip:
            roll, kind = (r.random(), int(r.integers(4))) if follow is None else (0, follow)
            piece, k = (makers[kind](), kind) if roll < 0.13 else (other(), None) if roll < 0.28 else (pick([str.lower, str.lower, str.title, str.upper])(letters(1, 10)), None)
            tags += [0] * len(piece) if k is None else [2 * k + 1] + [2 * k + 2] * (len(piece) - 1)
            glue = pick([" ", " ", " ", " ", ", ", ".\n", "\n", ". ", "### ", "&&& ", ": ", ' = "', "!! "])
            follow = {2: 2, 3: 1}.get(k) if r.random() < 0.2 else None  # a card beside a card, an IP after a phone
            glue = glue if follow is None else " "
            text, tags = text + piece + glue, tags + [0] * len(glue)
        y = np.array(tags[skip : skip + length], np.int8)
        if y[0] and y[0] % 2 == 0:  # cut at the left edge: it begins here
            y[0] -= 1
        texts.append(text[skip : skip + length])
        xs[:, col], ys[:, col] = classes(texts[-1]), y
    return xs, ys, texts


@lru_cache(maxsize=2)
def trained(steps: int = 500, batch: int = 48, length: int = 64, seed: int = 5) -> Tagger:
    """The tagger, trained on labelled spans; the same for the same parameters."""
    m, mean, var = Tagger(), {}, {}
    x, y, _ = labelled(1536, length, seed)
    r = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        rows = r.integers(0, x.shape[1], batch)
        _, g = m.loss(x[:, rows], y[:, rows])
        norm = np.sqrt(sum((v * v).sum() for v in g.values()))
        rate = 0.03 * (1 - step / (steps + 1)) + 0.001
        for name, v in g.items():
            v = v * min(1, 1 / max(norm, 1e-9))
            mean[name] = 0.9 * mean.get(name, 0) + 0.1 * v
            var[name] = 0.99 * var.get(name, 0) + 0.01 * v * v
            m.p[name] = m.p[name] - rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(var[name] / (1 - 0.99**step)) + 1e-8)
    m.p = {k: v.astype(np.float32) for k, v in m.p.items()}
    return m
