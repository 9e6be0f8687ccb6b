"""A bidirectional LSTM in numpy that labels the leaf blocks of a document, and the labelled sample it learns from."""

from __future__ import annotations

import re
import zlib

import numpy as np

from ticketloom.llm.markup_blocks import NONE, Block, blocks, squeeze

KINDS = (NONE, "heading", "list_item", "code_block", "formula")
PATHS, WORDS, PATH_DIM, WORD_DIM, HIDDEN = 8192, 512, 16, 6, 16
#: Documents of the generated labelled sample, and passes over it.
SAMPLE, EPOCHS, SEED = 3000, 6, 11
#: Share of the tag paths that a pass replaces by random ones.
UNKNOWN = 0.1
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")

#: A document's features: per block two path hashes, and the hashes of all its words.
Features = tuple[list[tuple[int, int]], list[list[int]]]


class _Buckets(dict):
    """word -> bucket; common words are remembered."""

    def __missing__(self, word: str) -> int:
        at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        if len(self) < 100_000:
            self[word] = at
        return at


_BUCKET = _Buckets().__getitem__


def features(bs: list[Block]) -> Features:
    """Per block the hashes of its whole tag path and of the last tag, and those of all its words."""
    return (
        [(zlib.crc32(b.path.encode()) % PATHS, zlib.crc32(b"/" + b.path.rpartition("/")[2].encode()) % PATHS) for b in bs],
        [list(map(_BUCKET, _WORD.findall(b.source))) for b in bs],
    )


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d = PATH_DIM + WORD_DIM
    w = {"path": rng.normal(0, 0.02, (PATHS, PATH_DIM)), "word": rng.normal(0, 0.3, (WORDS, WORD_DIM)),
         "out": rng.normal(0, 0.3, (2 * HIDDEN + d, len(KINDS))), "out_b": np.zeros(len(KINDS))}
    for side in "fb":
        w[side + "x"] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * HIDDEN))
        w[side + "h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[side + "b"] = np.zeros(4 * HIDDEN)
        w[side + "b"][HIDDEN:2 * HIDDEN] = 1
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _pad(docs: list[Features]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(time, document, 2) path hashes, the mask of real blocks, and all words with the cell (time * documents + document) each belongs to."""
    length = max(len(p) for p, _ in docs)
    path = np.zeros((length, len(docs), 2), np.int64)
    mask = np.zeros((length, len(docs)), bool)
    for k, (p, _) in enumerate(docs):
        path[:len(p), k] = p
        mask[:len(p), k] = True
    words = np.fromiter((x for _, ws in docs for w in ws for x in w), np.int64)
    cell = np.repeat(
        np.fromiter((t * len(docs) + k for k, (_, ws) in enumerate(docs) for t in range(len(ws))), np.int64),
        np.fromiter((len(w) for _, ws in docs for w in ws), np.int64),
    )
    return path, mask, words, cell


def _run(w: dict[str, np.ndarray], side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of one direction; the state rests where the mask is False, so padding changes nothing."""
    steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
    h = np.zeros((x.shape[1], HIDDEN), x.dtype)
    c = np.zeros_like(h)
    pre = x @ w[side + "x"] + w[side + "b"]
    out, tape = np.zeros((*x.shape[:2], HIDDEN), x.dtype), []
    for t in steps:
        z = pre[t] + h @ w[side + "h"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in (0, 1, 2))
        g = np.tanh(z[:, 3 * HIDDEN:])
        c1 = f * c + i * g
        tc = np.tanh(c1)
        h1 = o * tc
        m = mask[t][:, None]
        tape.append((t, h, c, i, f, o, g, tc, m))
        h, c = np.where(m, h1, h), np.where(m, c1, c)
        out[t] = h
    return out, tape


def _inputs(w: dict[str, np.ndarray], path: np.ndarray, words: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, document, PATH_DIM + WORD_DIM): the sum of both path vectors and the mean of the word vectors; also the number of words of each cell."""
    n = np.bincount(cell, minlength=path.shape[0] * path.shape[1])
    mean = np.stack([np.bincount(cell, w["word"][words, d], len(n)) for d in range(WORD_DIM)], axis=1) / np.maximum(n, 1)[:, None]
    mean = mean.astype(w["path"].dtype).reshape(*path.shape[:2], WORD_DIM)
    return np.concatenate([w["path"][path].sum(axis=2), mean], axis=2), n


def _logits(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
    hf, tf = _run(w, "f", x, mask)
    hb, tb = _run(w, "b", x, mask)
    both = np.concatenate([hf, hb, x], axis=2)
    return both @ w["out"] + w["out_b"], both, tf, tb


def scores(w: dict[str, np.ndarray], docs: list[Features]) -> list[np.ndarray]:
    """Class scores (blocks x KINDS) of each document. Documents of like length run together; every document has a block at least."""
    order = sorted(range(len(docs)), key=lambda k: len(docs[k][0]))
    result: list[np.ndarray] = [None] * len(docs)  # type: ignore[list-item]
    for a in range(0, len(order), 256):
        part = order[a:a + 256]
        path, mask, words, cell = _pad([docs[k] for k in part])
        logits = _logits(w, _inputs(w, path, words, cell)[0], mask)[0]
        for j, k in enumerate(part):
            result[k] = logits[:len(docs[k][0]), j]
    return result


def _gradients(w: dict[str, np.ndarray], path: np.ndarray, mask: np.ndarray, words: np.ndarray, cell: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    x, n = _inputs(w, path, words, cell)
    logits, both, tf, tb = _logits(w, x, mask)
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    d = p.copy()
    np.put_along_axis(d, labels[..., None], np.take_along_axis(d, labels[..., None], 2) - 1, 2)
    d *= mask[..., None] / mask.sum()
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"] = np.tensordot(both, d, ((0, 1), (0, 1)))
    g["out_b"] = d.sum((0, 1))
    dh_all = d @ w["out"].T
    dx = dh_all[..., 2 * HIDDEN:].copy()
    for side, tape, lo in (("f", tf, 0), ("b", tb, HIDDEN)):
        dh = np.zeros((x.shape[1], HIDDEN))
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, gg, tc, m in reversed(tape):
            dh = dh + dh_all[t][:, lo:lo + HIDDEN]
            do = dh * tc
            dc1 = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc1 * gg * i * (1 - i), dc1 * c * f * (1 - f), do * o * (1 - o), dc1 * i * (1 - gg * gg)], axis=1) * m
            g[side + "x"] += x[t].T @ dz
            g[side + "h"] += h.T @ dz
            g[side + "b"] += dz.sum(0)
            dx[t] += dz @ w[side + "x"].T
            dh, dc = np.where(m, dz @ w[side + "h"].T, dh), np.where(m, dc1 * f, dc)
    for k in (0, 1):
        np.add.at(g["path"], path[mask][:, k], dx[mask][:, :PATH_DIM])
    per_word = dx.reshape(-1, PATH_DIM + WORD_DIM)[:, PATH_DIM:] / np.maximum(n, 1)[:, None]
    np.add.at(g["word"], words, per_word[cell])
    return g


def train(sample: int = SAMPLE, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Weights after `epochs` of Adam over `sample` generated documents; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    data = [(features(b), y) for b, y in labelled_sample(sample, seed)]
    w = init(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), 32):
            part = [data[k] for k in order[a:a + 32]]
            path, mask, words, cell = _pad([f for f, _ in part])
            labels = np.zeros(mask.shape, np.int64)
            for k, (_, y) in enumerate(part):
                labels[:len(y), k] = y
            # Some paths are made unknown ones, so that the last tag alone is learnt as well.
            path[..., 0] = np.where(rng.random(mask.shape) < UNKNOWN, rng.integers(0, PATHS, mask.shape), path[..., 0])
            step += 1
            for k, g in _gradients(w, path, mask, words, cell, labels).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                w[k] = w[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


_NAMES = "cache ledger printer queue mirror invoice account folder editor portal driver kernel cursor packet".split()


_WRAPS = {
    "plain": ["{}"],
    "html": ["<b>{}</b>", "<em>{}</em>", "<code>{}</code>", '<a href="u">{}</a>'], "latex": [r"\textbf{{{}}}", r"\emph{{{}}}", r"\texttt{{{}}}", r"\href{{u}}{{{}}}"],
    "md": ["**{}**", "_{}_", "`{}`", "[{}](http://u)", "~~{}~~", "__{}__", "*{}*"], "wiki": ["*{}*", "_{}_", "{{{{{}}}}}", "[{}|http://u]", "{{color:red}}{}{{color}}", "+{}+", "??{}??"],
}


def _phrase(rng: np.random.Generator, n: int, style: str) -> str:
    """n words, some of them in inline markup or made up."""
    words = []
    for w in rng.choice(_NAMES, n):
        w = str(w) if rng.random() < 0.6 else "".join(rng.choice(list("abdefgiklmnoprstuvz"), rng.integers(4, 10)))
        w = w.title() if rng.random() < 0.4 else w
        words.append(str(rng.choice(_WRAPS[style])).format(w) if rng.random() < 0.2 else w)
    return " ".join(words)


def _pieces(rng: np.random.Generator, style: str) -> list[tuple[str, str, list[str]]]:
    """(source, kind, the sources of its elements of that kind) of the parts of one generated document in one notation."""
    p = lambda n=4: _phrase(rng, n, style)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    a, b = rng.choice(list("abcdkmnpqrstuvxyz"), 2)
    n = int(rng.integers(1, 99))
    math = pick([f"{a}_{{{b}}} = \\frac{{{a}}}{{{n}}}", f"\\alpha {a} + \\beta {b} = {n}{a}", f"O({a} \\log {a}) + {n}", f"\\sum_{{{a}=1}}^{{{n}}} {b}_{a}", f"\\sqrt{{{a}^2 + {b}^2}} = {n}",
                 f"{a}^{{{n}}} \\cdot {b}", f"{a} \\le {b} < {n}", f"\\int_0^{{{n}}} {a} d{b}", f"{a} = {b} + {n}", f"\\min({a}, {b})", f"|{a}| \\ge {n}", f"({a} - {b}) / {n}", f"{a}", f"{a}({b})", f"{n}{a}", f"{a}_{n}", f"{a}_{b}", f"{a}^2"])
    lines = ["x = run(1)", "    return a[0];", "# changes the cache", "- key: value", "* item line", "if (a < b) {", "<item id=\"1\"/>", "at a.b(c:1)", "$ make all", "h1. not a title", "1. first", "== done =="]
    code = "\n".join(pick(lines) for _ in range(rng.integers(1, 6)))
    stray = [f"#7 {p(3)}", f"#!{p(2)}", f">{p(4)}", f"$5 or $7 per {p(1)}", f"+1 for the {p(1)}", f"=> {p(2)}", f"--{p(2)}", "the {curly} word", f"-1 {p(2)}", f"cost 5 * 3 {p(1)}", f"-- {p(2)}", f"+- {p(2)}", f"open $HOME/$USER {p(1)}", f"{p(1)} and $path:$home {p(1)}", f"{a} < {b} and {b} > {a}"]
    items = [p(rng.integers(1, 6)) + (f" ${math}$" if style in ("md", "latex") and rng.random() < 0.05 else "") for _ in range(rng.integers(1, 6))]
    out: list[tuple[str, str, list[str]]] = []
    for _ in range(rng.integers(1, 9)):
        kind = pick(["text", "text", "stray", "heading", "list", "code", "formula"])
        if kind == "text":
            s = p(int(rng.integers(1, 14))) + pick([".", "", ":", "?"])
            cells = [[p(1) for _ in range(2)] for _ in range(3)]
            out.append((pick({
                "html": [f"<p>{s}</p>", f"<p>{s}</p>", f"<div>{s}</div>", f"<blockquote>{s}</blockquote>", f"<blockquote><p>{s}</p></blockquote>", s, f"<dl><dt>{cells[0][0]}</dt><dd>{s}</dd></dl>",
                         "<table>" + pick(["", "<tbody>"]) + "<tr>" + "".join(f"<th>{c}</th>" for c in cells[0]) + "</tr>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells[1:]) + "</table>"],
                "latex": [s, s, f"\\begin{{quote}}\n{s}\n\\end{{quote}}", "\\begin{tabular}{lr}\n" + "\n".join(" & ".join(r) + r" \\\\" for r in cells) + "\n\\end{tabular}"],
                "md": [s, s, f"> {s}", "\n".join("| " + " | ".join(r) + " |" for r in cells)],
                "wiki": [s, s, f"{{quote}}{s}{{quote}}", f"bq. {s}", "\n".join("|" + "|".join(r) + "|" for r in cells)],
                "plain": [s, f"{s}\n{p(5)}.", s],
            }[style]), NONE, []))
        elif kind == "stray" or style == "plain":
            out.append((f"<p>{pick([p(4), stray[3], stray[12]])}</p>" if style == "html" else pick(stray), NONE, []))
        elif kind == "heading":
            n = int(rng.integers(1, 7))
            title = p(int(rng.integers(1, 5)))
            setext = f"{title}\n{('=' if n < 3 else '-') * int(rng.integers(2, 24))}"
            section = pick([["section", "part"], ["subsection"], ["subsubsection"], ["paragraph"], ["chapter"], ["subparagraph"]][n - 1])
            out.append(({"html": pick([f"<h{n}>{title}</h{n}>", f'<h{n} class="a">{title}</h{n}>']), "latex": f"\\{section}{pick(['', '*'])}{{{title}}}",
                         "md": f"{'#' * n} {title}" if rng.random() < 0.7 else setext, "wiki": f"h{n}. {title}"}[style], "heading", [title]))
        elif kind == "list":
            mark = pick(["-", "*", "+"])
            ordered = rng.random() < 0.4
            tag = "ol" if ordered else "ul"
            inner = pick(["<li>{}</li>", "<li>{}</li>", "<li>{}", "<li><p>{}</p></li>"] if rng.random() < 0.2 else ["<li>{}</li>"])
            nested = f"<{pick(['ul', 'ol'])}>" + "".join(f"<li>{x}</li>" for x in items[1:])
            deep = f"<{tag}><li>{items[0]}{nested}</{nested[1:3]}></li></{tag}>"
            flat = f"<{tag}>" + "".join(inner.replace("{}", x) for x in items) + f"</{tag}>"
            out.append(({
                "html": deep if len(items) > 1 and "<p>" not in inner and rng.random() < 0.15 else pick(["{}", "{}", "{}", "{}", "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>"]).replace("{}", flat),
                "latex": "\\begin{itemize}\n" + "\n".join(f"\\item {x}" for x in items) + "\n\\end{itemize}",
                "md": "\n".join(f"{k + 1}{'.' if mark == '-' else ')'} {x}" if ordered else f"{pick(['', '', '  ']) if k else ''}{mark} {x}" for k, x in enumerate(items)),
                "wiki": "\n".join(f"{'#' if ordered and len(items) > 1 else '*' * (1 + k % 3) if mark == '*' else '-'} {x}" for k, x in enumerate(items)),
            }[style], "list_item", items if "<p>" not in inner or style != "html" else []))
        elif kind == "code":
            name = pick(["verbatim", "lstlisting"])
            out.append(({"html": pick([f"<pre>{code}</pre>", f"<pre><code>{code}</code></pre>", f'<pre class="x">{code}</pre>']), "latex": f"\\begin{{{name}}}\n{code}\n\\end{{{name}}}",
                         "md": pick([f"```\n{code}\n```", f"```sh\n{code}\n```", f"~~~\n{code}\n~~~"]),
                         "wiki": pick([f"{{code}}\n{code}\n{{code}}", f"{{code:java}}\n{code}\n{{code}}", f"{{noformat}}\n{code}\n{{noformat}}"])}[style], "code_block", [code, f"<code>{code}</code>"]))
        else:
            form = {"html": [f"\\({math}\\)", f"\\[{math}\\]"], "latex": [f"\\({math}\\)", f"\\[ {math} \\]", f"\\begin{{equation}}\n{math}\n\\end{{equation}}", f"\\begin{{align*}}\n{math}\n\\end{{align*}}", f"${math}$", f"$${math}$$"],
                    "md": [f"${math}$", f"$${math}$$", f"$$\n{math}\n$$"], "wiki": [f"{{math}}{math}{{math}}", f"{{latex}}{math}{{latex}}"]}[style]
            s = pick(["We expect {} here.", "{}", "{} holds.", "so {}"]).replace("{}", pick(form))
            out.append((f"<p>{s}</p>" if style == "html" else s, "formula", [math]))
    if style == "html" and rng.random() < 0.4:
        around = pick(["<html><body>{}</body></html>", "<div>{}</div>", "<body>{}</body>"])
        out = [(around.replace("{}", x), kind, sources) for x, kind, sources in out]
    return out


def labelled_sample(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """n generated documents as (blocks, labels).

    A block has its part's kind if its source is that of one of the part's elements as they were generated (formulas
    inside an item are formulas); all others are none. Parts are cut one by one and make one sequence of blocks.
    """
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        bs: list[Block] = []
        ys: list[int] = []
        for source, kind, sources in _pieces(rng, str(rng.choice(["html", "md", "wiki", "latex", "plain"], p=[0.22, 0.24, 0.22, 0.22, 0.10]))):
            known = {squeeze(x.replace("$", " ")) for x in sources}
            for b in blocks(source):
                own = squeeze(b.source.replace("$", " ")) in known
                inside = kind == "list_item" and b.path.startswith("dollar/")
                bs.append(b)
                ys.append(KINDS.index("formula" if inside else kind if own else NONE))
        if bs:
            out.append((bs, ys))
    return out
