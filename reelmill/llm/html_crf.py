"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

Blocks carry hashed features of their ancestors (tags; class and id words and pieces of them), of their text, and of where
they stand: in the element that holds most of the page's unlinked text or how far from it, beside the first heading or
not, in a run of alike siblings, among links. The field has one weight a feature and label and one a pair of neighbouring
labels. It is trained by gradient ascent on the conditional likelihood of labelled pages. Tables of pages carry no labels,
so the labelled pages are layouts made by `layout`: articles with tables, lists, unclosed tags and foreign parts inside,
among menus, footers, sidebars, notices, adverts, forms and comments, filled with texts of the table's own blocks. Two
parts in three have a name without a meaning or none, so that structure has to tell what they are. What a part is follows
from where the layout puts it; no rule reads the labels off a given page. Pages are decoded by Viterbi in the tasks.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import escape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import byte_pieces, stored
from reelmill.llm.html_blocks import Block, parse

BUCKETS = 1 << 14
#: Bytes of pages that a task takes from a batch at once.
BATCH_BYTES = 4 << 20
#: The layouts are filled with texts of at most this many distinct blocks of the table, chosen by a hash.
SAMPLE_BLOCKS = 1500
#: The field is trained on so many layouts.
LAYOUTS = 1500

#: Words by which layouts name some of their parts; used to make training layouts only.
MAIN_WORDS = "content post entry article main story body text page single".split()
WRAP_WORDS = "wrapper container site inner row col grid layout center outer".split()
SIDE_WORDS = {
    "nav": "nav menu navigation breadcrumb pagination topbar".split(),
    "header": "header masthead top branding hero".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside related widget popular tags rail".split(),
    "div": "ad ads advert advertisement sponsored promo banner".split(),
    "section": "comments comment discussion replies reply respond".split(),
    "dialog": "cookie notice consent popup alert gdpr modal".split(),
    "form": "form newsletter subscribe login search signup".split(),
    "ul": "social share sharing follow".split(),
}
FILLER = ["It rained all day in the valley.", "The council met on Monday, and most members agreed.", "Prices rose by two percent; wages did not.", "She wrote that the results, though early, were clear."]
MENU = "Home About Contact News Archive Login Search Help Shop Blog".split()


@lru_cache(1 << 16)
def _slot(name: str) -> int:
    return crc32(name.encode()) % BUCKETS


class _Slots(dict):
    """The slot of a feature that is a name and small numbers or a tag; there are few of them."""

    def __missing__(self, key: tuple) -> int:
        self[key] = slot = crc32(repr(key).encode()) % BUCKETS
        return slot


_SLOTS = _Slots()


def path_features(path: tuple) -> list[int]:
    names = [f"own:{path[-1][0]}" if path else "own:"]
    for depth, (tag, hints) in enumerate(reversed(path)):
        names.append(f"tag:{tag}")
        if depth < 2:
            names.append(f"near{depth}:{tag}")
        for h in hints:
            names.append(f"hint:{h}")
            names += [f"piece:{h[i : i + 5]}" for i in range(max(1, len(h) - 4))]
            if depth == 0:
                names.append(f"ownhint:{h}")
    return sorted({_slot(n) for n in names})


def _share(part: float, whole: float) -> int:
    return min(4, int(5 * part / whole)) if whole else 0


#: Elements that hold a paragraph or less; none of them is a page's core.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt figcaption caption address".split())


def place_features(blocks: list[Block]) -> list[list[int]]:
    """For each block of a page, what its surroundings tell."""
    chars, links, counts, alike, long_ones = Counter(), Counter(), Counter(), Counter(), Counter()
    kinds: dict[int, tuple] = {}
    for b in blocks:
        n, up = len(b.text), 0
        for node, (tag, hints) in zip(b.nodes, b.path, strict=False):
            chars[node] += n - b.link_chars
            links[node] += b.link_chars
            counts[node] += 1
            long_ones[node] += n > 120
            if node not in kinds:
                kinds[node] = (up, tag, hints)
                alike[up, tag, hints] += 1
            up = node
    whole = sum(len(b.text) - b.link_chars for b in blocks)
    # the core: from the root down as long as one element holds most of the text without links
    core = max((node for node in chars if whole and chars[node] >= 0.6 * whole and kinds[node][1] not in LEAVES and kinds[node][1] not in ("html", "body")), default=0)
    heads = [i for i, b in enumerate(blocks) if b.path and b.path[-1][0] in ("h1", "h2")]
    head = next((i for i in heads if blocks[i].path[-1][0] == "h1"), heads[0] if heads else None)
    head_up = blocks[head].nodes[-2::-1] if head is not None else ()
    if not core:
        # no element stands out: the one that the heading lies in
        core = next((x for x in reversed(head_up) if kinds[x][1] not in ("html", "body")), 0)
    if core and core not in head_up:
        # the heading stands beside the core: what holds both is the core if it holds little else
        up = next((b.nodes for b in blocks if core in b.nodes), ())
        both = next((x for x in head_up if x in up and kinds[x][1] not in ("html", "body")), 0)
        core = both if both and links[both] + chars[both] - chars[core] <= 0.3 * chars[both] + 80 else core
    first_core = next((i for i, b in enumerate(blocks) if core in b.nodes), 0)
    # what an element's own numbers tell of any block in it
    about: dict[int, tuple] = {}
    for node in chars:
        total = chars[node] + links[node]
        same = min(3, alike[kinds[node]].bit_length()) if alike[kinds[node]] > 1 else 0
        about[node] = (_share(links[node], total), _share(chars[node], whole), min(6, counts[node].bit_length()), min(4, long_ones[node].bit_length()), same, kinds[node][1], counts[node] > 1)
    out, seen, slots, n_blocks = [], 0, _SLOTS, len(blocks)
    shapes = [(min(10, len(b.text).bit_length()), 2 * b.link_chars // max(1, len(b.text))) for b in blocks]
    for i, b in enumerate(blocks):
        n, nodes, tag = len(b.text), b.nodes, b.path[-1][0] if b.path else ""
        free = n - b.link_chars
        names = [slots["at", min(9, 10 * i // n_blocks)], slots["read", _share(seen, whole)]]
        seen += free
        below = nodes[nodes.index(core) :] if core in nodes else ()
        if below:
            where = min(2, len(below))
            names.append(slots["core", min(4, len(below)), tag])
            inner = below[1:-1] or below[1:]
            # whether the branch below the core that holds the block is prose, and how much of the core it is
            names.append(slots["branch", _share(chars[inner[0]], chars[core]) if inner else 5, min(3, long_ones[inner[0]]) if inner else 3, len(below) > 2])
        else:
            where = 3 if i < first_core else 4
            names.append(slots["core", where])
            names.append(slots["apart", min(3, sum(long_ones[x] for x in nodes[-1:]))])
        for d, node in enumerate(nodes[-2::-1][:2] or nodes[-1:]):
            linked, part, many, prose, *_ = about[node]
            names += (slots["linked", d, linked], slots["part", d, part], slots["many", d, many], slots["prose", d, prose])
        for d, node in enumerate(nodes[::-1][:4]):
            *_, same, kind, several = about[node]
            if same and several:
                names.append(slots["items", d, kind, same])
            elif same and d < 2:
                names.append(slots["alike", d, kind, same])
        size, own_links = min(9, n.bit_length()), 3 * b.link_chars // max(1, n)
        up = nodes[-2] if len(nodes) > 1 else 0
        names += (slots["size", where, size, own_links], slots["in", where, about[up][0] if up else 0, min(3, long_ones[up]), tag], slots["page", _share(free, whole), size, own_links])
        if head is not None:
            level = next((k for k, x in enumerate(head_up[:4]) if x in nodes), 4)
            names += (slots["head", level, (i > head) - (i < head)], slots["headin", where, level, size], slots["headdist", max(-3, min(3, i - head))])
        else:
            names.append(slots["nohead",])
        names.append(slots["prev", *shapes[i - 1]] if i else slots["prev",])
        names.append(slots["next", *shapes[i + 1]] if i + 1 < n_blocks else slots["next",])
        out.append(names)
    return out


def text_features(block: Block) -> list[int]:
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    names = ["bias", f"len:{min(10, n.bit_length())}", f"words:{min(8, words.bit_length())}", f"link:{4 * block.link_chars // max(1, n)}", f"last:{text[-1] if not text[-1].isalnum() else 'x'}"]
    stops = sum(map(text.count, ".,;:!?"))
    names += [f"stops:{min(4, stops)}", f"dense:{min(5, 40 * stops // n)}", f"digit:{min(3, 8 * sum(map(str.isdigit, text)) // n)}" if n < 200 else "digit:-"]
    if text[0] in "©®™":
        names.append("mark")
    if "©" in text or "|" in text or "·" in text:
        names.append("sep")
    if words <= 3:
        names += [f"word:{w}" for w in text.lower().split()]
    return [_slot(x) for x in names]


class Field:
    """emit: BUCKETS x 2 weights; step: 2 x 2 weights of neighbours. Label 1 is main text."""

    def __init__(self, emit: np.ndarray, step: np.ndarray) -> None:
        self.emit, self.step = emit, step
        self._paths: dict[tuple, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"emit": self.emit, "step": self.step}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def scores(self, blocks: list[Block]) -> np.ndarray:
        if not blocks:
            return np.empty((0, 2))
        if len(self._paths) > 50_000:
            self._paths.clear()
        base, flat, begin = [], [], []
        for b, place in zip(blocks, place_features(blocks), strict=True):
            known = self._paths.get(b.path)
            if known is None:
                known = self._paths[b.path] = self.emit[path_features(b.path)].sum(0)
            base.append(known)
            begin.append(len(flat))
            flat += text_features(b)
            flat += place
        return np.array(base) + np.add.reduceat(self.emit[flat], begin, axis=0)

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most probable labels (Viterbi; ties go to 0)."""
        if not blocks:
            return []
        scores = self.scores(blocks).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = scores[0]
        back: list[tuple[int, int]] = []
        for e0, e1 in scores[1:]:
            from0, from1 = int(b + s10 > a + s00), int(b + s11 > a + s01)
            a, b = e0 + (b + s10 if from0 else a + s00), e1 + (b + s11 if from1 else a + s01)
            back.append((from0, from1))
        label = int(b > a)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def _phrase(rng: random.Random, texts: list[str], kind: str) -> str:
    """Escaped words from the given texts: a word or two, a line, a sentence or a paragraph."""
    words = rng.choice(texts).split()
    n = {"word": rng.randint(1, 3), "line": rng.randint(2, 9), "sentence": rng.randint(6, 25), "paragraph": rng.randint(20, 250)}[kind]
    at = rng.randint(0, max(0, len(words) - n))
    return escape(" ".join(words[at : at + n]) or "x")


def _main_part(rng: random.Random, texts: list[str]) -> str:
    """A part of an article: mostly paragraphs, else any element that holds text, some of them never closed."""
    kind = rng.random()

    def phrase() -> str:
        return _phrase(rng, texts, rng.choice(["word", "line", "sentence", "paragraph"]))

    if kind < 0.55:
        text = _phrase(rng, texts, rng.choice(["line", "sentence", "paragraph", "paragraph"]))
        if rng.random() < 0.2:
            text += f' <a href="/x">{_phrase(rng, texts, "word")}</a> {_phrase(rng, texts, "line")}'
        return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>"]).format(text)
    if kind < 0.72:
        return rng.choice(["<div>{}</div>", "<p>{}<div>{}</div>", "<blockquote>{}</blockquote>", "<h2>{}</h2>", "<h3>{}</h3><p>{}</p>", "<pre>{}</pre>", "<section><p>{}</p></section>", "<figure><figcaption>{}</figcaption></figure>", "<dl><dt>{}<dd>{}</dl>"]).replace("{}", "\0").replace("\0", phrase(), 1).replace("\0", phrase())
    if kind < 0.86:
        own, shut = rng.choice(["ul", "ol"]), rng.choice(["</li>", ""])
        return f"<{own}>" + "".join(f"<li>{phrase()}{shut}" for _ in range(rng.randint(1, 6))) + f"</{own}>"
    shut, width = rng.choice([True, False]), rng.randint(1, 4)
    rows = []
    for k in range(rng.randint(1, 5)):
        cell = "th" if k == 0 and rng.random() < 0.6 else "td"
        cells = [str(rng.randint(0, 10**rng.randint(1, 6))) if cell == "td" and rng.random() < 0.4 else _phrase(rng, texts, rng.choice(["word", "word", "line", "sentence"])) for _ in range(width)]
        rows.append("<tr>" + "".join(f"<{cell}>{c}" + f"</{cell}>" * shut for c in cells) + "</tr>" * shut)
    return "<table>" + "".join(rows) + "</table>"


def _name(rng: random.Random, words: list[str], most: float = 0.35) -> str:
    """An attribute that names a part: by a word with a meaning, by letters without one, or none."""
    kind, attribute = rng.random(), rng.choice(["class", "class", "id"])
    if kind < most:
        return f' {attribute}="{rng.choice(["", "", "site-", "my"])}{rng.choice(words)}{rng.choice(["", "", "-box", " wrap", "-list", "list", "s"])}"'
    if kind < most + 0.35:
        return f' {attribute}="{"".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))}{rng.choice(["", "", "-" + str(rng.randint(1, 40))])}"'
    return ""


def _comments(rng: random.Random, texts: list[str]) -> str:
    """Readers' posts: alike items of a name, mostly a time, a text and perhaps a link to answer."""
    holder, item = rng.choice([("ol", "li"), ("ul", "li"), ("div", "div"), ("div", "article"), ("section", "p"), ("div", "p"), ("div", "blockquote")])
    named, alone = _name(rng, SIDE_WORDS["section"], 0.2), item in ("p", "blockquote") or rng.random() < 0.15
    posts = []
    for _ in range(rng.randint(1, 6)):
        who, text = _phrase(rng, texts, "word"), _phrase(rng, texts, rng.choice(["line", "sentence", "sentence", "paragraph"]))
        when = rng.choice(["", f" {rng.randint(1, 12)} {rng.choice(['hours', 'days', 'min'])} ago", f" {rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(10, 24)}", " says:"])
        answer = rng.choice(["", "", '<a href="#r">Reply</a>', "<span>Like</span>"])
        held = f"{rng.choice(['', who + ': '])}{text}" if alone else rng.choice([f"<b>{who}</b>{when}<p>{text}</p>{answer}", f"<div>{who}{when}</div><div>{text}</div>{answer}", f"<p>{who}{when}</p><p>{text}</p>{answer}", f"<cite>{who}</cite>{when} {text} {answer}"])
        posts.append(f"<{item}{named}>{held}</{item}>")
    head = f"<{(t := rng.choice(['h2', 'h3', 'h4', 'div']))}>{rng.choice([_phrase(rng, texts, 'word'), f'{rng.randint(1, 90)} comments', 'Comments', 'Responses'])}</{t}>"
    body = f"<{holder}>" + "".join(posts) + f"</{holder}>" if rng.random() < 0.6 else "".join(posts)
    return head * (rng.random() < 0.6) + body


def _side_part(rng: random.Random, texts: list[str], tag: str, most: float = 0.35) -> str:
    """A labelled part that is no main text: its element, or another one, with or without a name."""
    own = tag if rng.random() < 0.45 else rng.choice(["div", "div", "div", "section"] if tag != "section" else ["div", "ol", "section"])
    name = _name(rng, SIDE_WORDS[tag], most)
    many = range(rng.randint(1, 5))

    def link() -> str:
        return f'<a href="/x">{rng.choice([_phrase(rng, texts, "word"), rng.choice(MENU)])}</a>'

    if tag == "section":
        if own == "ol":
            body = "".join(f"<li>{_phrase(rng, texts, 'word')} {rng.choice(['', '2 days ago'])}<p>{_phrase(rng, texts, rng.choice(['line', 'sentence']))}</p></li>" for _ in many)
        else:
            body = _comments(rng, texts)
    elif tag in ("nav", "ul", "header") and rng.random() < 0.35:
        between = rng.choice([" | ", " ", " &middot; ", " &gt; "])
        body = between.join(link() if rng.random() < 0.75 else rng.choice(MENU) for _ in range(rng.randint(2, 6)))
        body = f"<{(t := rng.choice(['p', 'div', 'span']))}>{body}</{t}>" if rng.random() < 0.5 else body
    elif tag in ("nav", "ul") or tag in ("header", "aside", "footer") and rng.random() < 0.4:
        body = f"<h3>{_phrase(rng, texts, 'word')}</h3>" * (tag == "aside" and rng.random() < 0.5) + "<ul>" + "".join(f"<li>{link()}" + "</li>" * rng.randint(0, 1) for _ in many) + "</ul>"
    elif tag == "header":
        body = rng.choice(["{}", "<div>{}</div>", "<p>{}</p>", "<a href='/'>{}</a>"]).format(_phrase(rng, texts, rng.choice(["word", "word", "line"])))
    elif tag == "footer":
        body = rng.choice(["", "&copy; ", "\u00a9 2020 ", "Copyright 2021 "]) + rng.choice([" &middot; ", " | ", " "]).join(_phrase(rng, texts, rng.choice(["word", "word", "line", "sentence"])) for _ in range(rng.randint(1, 2)))
    elif tag == "form":
        body = f'<label>{_phrase(rng, texts, "word")}</label><input name="q"><button>{_phrase(rng, texts, "word")}</button>' + f"<p>{_phrase(rng, texts, 'line')}</p>" * rng.randint(0, 1)
    elif rng.random() < 0.5:
        body = _phrase(rng, texts, rng.choice(["line", "sentence"]))
    else:
        body = "".join(f"<p>{_phrase(rng, texts, rng.choice(['word', 'line', 'line', 'sentence']))}</p>" for _ in many)
    if tag == "form" and own != "form":
        body = f"<form>{body}</form>"
    return f'<{own}{name} data-y="0">{body}</{own}>'


def layout(rng: random.Random, texts: list[str]) -> str:
    """A labelled page (data-y) in a random layout, filled with words of the given texts."""
    top = [f"<{(t := rng.choice(['h1', 'h1', 'h1', 'h2']))}>{_phrase(rng, texts, rng.choice(['line', 'sentence']))}</{t}>"] * (rng.random() < 0.9)
    if rng.random() < 0.25:
        top.append(rng.choice(["<p>By {}</p>", "<div>{}</div>", "<p>{}, 3 May 2021</p>", "<address>{}</address>"]).format(_phrase(rng, texts, "word")))
    if top and rng.random() < 0.2:
        top = [f"<header>{''.join(top)}</header>"]
    parts = [_main_part(rng, texts) for _ in range(rng.randint(1, 12))]
    if rng.random() < 0.85:
        # most articles have a text worth the name
        parts.insert(rng.randint(0, len(parts)), f"<p>{_phrase(rng, texts, 'paragraph')} {_phrase(rng, texts, 'sentence')}</p>")
    if rng.random() < 0.25:
        # a short piece: a few sentences
        parts = [f"<p>{_phrase(rng, texts, 'sentence' if rng.random() < 0.85 else 'line')}</p>" for _ in range(rng.randint(2, 6))]
    kind = rng.random()
    if kind < 0.06:
        parts = ["<br><br>".join(_phrase(rng, texts, rng.choice(["sentence", "paragraph"])) for _ in range(rng.randint(1, 4)))]
        top = top if rng.random() < 0.5 else [f"<b>{_phrase(rng, texts, 'line')}</b><br>"]
    elif kind < 0.16:
        parts = [x.replace("<p>", "<div>").replace("</p>", "</div>") if x.endswith("</p>") else x for x in parts]
    if rng.random() < 0.25:
        parts = [f"<div{_name(rng, WRAP_WORDS)}>{''.join(parts)}</div>"]
        top = [f"<div{_name(rng, WRAP_WORDS)}>{''.join(top)}</div>"] if rng.random() < 0.5 else top
    inner = top + parts
    for tag in ("div", "section", "ul", "form", "aside", "dialog", "nav", "footer"):
        if rng.random() < (0.27 if tag in ("form", "div") else 0.15):
            at = len(inner) if tag in ("section", "footer") and rng.random() < 0.7 else rng.randint(1, len(inner))
            # prose inside an article is foreign to it only by its name
            inner.insert(at, _side_part(rng, texts, tag, 0.9 if tag in ("div", "dialog", "aside") else 0.35))
    own = rng.choice(["article", "article", "main", "main", "div", "div", "div", "div", "section"])
    main = f'<{own}{_name(rng, MAIN_WORDS, 0.4)} data-y="1">' + "".join(inner) + f"</{own}>"
    share = rng.choice([0.2, 0.45, 0.6])
    tags = [t for t in SIDE_WORDS if rng.random() < share]
    below = [_side_part(rng, texts, "section")] * (rng.random() < 0.1)
    if rng.random() < 0.5:
        # as pages mostly are: what belongs on top, the article, the rest
        early = [t for t in ("header", "nav", "dialog", "div") if t in tags and rng.random() < 0.8]
        outer, at = early + [t for t in tags if t not in early], len(early)
    else:
        rng.shuffle(tags)
        outer, at = tags, rng.randint(0, len(tags))
    sides = [_side_part(rng, texts, t) for t in outer]
    if at and rng.random() < 0.15:
        sides.insert(0, f'<h1 data-y="1">{_phrase(rng, texts, "line")}</h1>')
        at += 1
    whole = [*sides[:at], main, *below, *sides[at:]]
    if rng.random() < 0.15:
        bare = rng.random() < 0.6  # cells that hold the parts' own elements no more
        cells = [("<td" + x[x.index(" data-y") : x.rindex("<")] + "</td>" if bare and " data-y" in x[: x.index(">")] else f"<td>{x}</td>") for x in whole]
        page = "<table>" + "".join(f"<tr>{c}</tr>" if rng.random() < 0.7 else c for c in cells) + "</table>"
    else:
        page = "".join(whole)
    for _ in range(rng.randint(0, 2)):
        page = f'<{rng.choice(["div", "div", "main"]) if own != "main" else "div"}{_name(rng, WRAP_WORDS)}>{page}</div>'
    return f"<html><body>{page}</body></html>"


def labelled(texts: list[str], seed: int = 5, layouts: int = LAYOUTS) -> list[list[Block]]:
    """Label sequences to train on, made from the texts of blocks."""
    rng = random.Random(seed)
    made = [parse(layout(rng, [*texts, *FILLER])).blocks for _ in range(layouts)]
    return [x for x in made if x]


def fit(pages: list[list[Block]], rounds: int = 100, rate: float = 0.1, l2: float = 1e-4) -> Field:
    """Conditional likelihood by Adam; forward and backward run over all pages at once, step by step."""
    longest = max(len(p) for p in pages)
    n = len(pages)
    where = [(i, t) for i, p in enumerate(pages) for t in range(len(p))]
    feats = [path_features(b.path) + text_features(b) + place for p in pages for b, place in zip(p, place_features(p), strict=True)]
    flat = np.concatenate([np.array(f) for f in feats])
    of = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    begin = np.concatenate(([0], np.cumsum([len(f) for f in feats])[:-1]))
    pi, ti = (np.array(x) for x in zip(*where, strict=True))
    gold = np.array([b.label or 0 for p in pages for b in p])
    size = np.array([len(p) for p in pages])
    y = np.zeros((n, longest), int)
    y[pi, ti] = gold
    inside = np.arange(longest)[None] < size[:, None]
    emit, step = np.zeros((BUCKETS, 2)), np.zeros((2, 2))
    moments = [np.zeros_like(x) for x in (emit, emit, step, step)]
    both = (inside[:, 1:] & inside[:, :-1]).astype(float)
    gold_step = np.zeros((2, 2))
    np.add.at(gold_step, (y[:, :-1].ravel(), y[:, 1:].ravel()), both.ravel())
    for turn in range(1, rounds + 1):
        s = np.zeros((n, longest, 2))
        s[pi, ti] = np.add.reduceat(emit[flat], begin, axis=0)
        f, b = np.zeros_like(s), np.zeros_like(s)
        f[:, 0] = s[:, 0]
        for t in range(1, longest):
            f[:, t] = np.where(inside[:, t, None], s[:, t] + np.logaddexp(f[:, t - 1, :1] + step[0], f[:, t - 1, 1:] + step[1]), f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = s[:, t + 1] + b[:, t + 1]
            b[:, t] = np.where(inside[:, t + 1, None], np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:]), 0)
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p = np.exp(f + b - z[:, None, None])
        pair = np.exp(f[:, :-1, :, None] + step + (s + b)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        err = p[pi, ti]
        err[np.arange(len(gold)), gold] -= 1
        g_emit = np.stack([np.bincount(flat, err[of, k], BUCKETS) for k in (0, 1)], 1) / n + l2 * emit
        g_step = (pair.sum((0, 1)) - gold_step) / n + l2 * step
        for x, g, m, v in ((emit, g_emit, moments[0], moments[1]), (step, g_step, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(emit, step)


def _block_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the blocks of the pages; of long ones the pieces of 300 words."""
    for batch in byte_pieces(batches, 0, BATCH_BYTES):
        out = []
        for html in batch.column(0):
            for block in parse(html.as_py()).blocks:
                words = block.text.split(" ")
                out += [" ".join(words[a : a + 300]) for a in range(0, len(words), 300)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])


def train(pages: DataFrame, html_col: str = "html", sample_blocks: int = SAMPLE_BLOCKS) -> Field:
    """A field trained on layouts filled with a bounded sample of the texts of the table's blocks: sample_blocks distinct
    ones of a sample of pages, both chosen by hashes, so that repeated pages or blocks count once. With no page the
    layouts have made texts alone."""
    html = pages.select(F.col(html_col).alias("html")).filter("length(html) > 0").withColumn("h", F.xxhash64("html"))

    def drawn(rows: DataFrame, n: int) -> DataFrame:
        """About n to 2n distinct rows, by a threshold on their hash: tasks send few rows on however many there are."""
        share = min(1.0, 1.5 * n / max(1, rows.agg(F.approx_count_distinct("h")).first()[0]))
        return rows.filter(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    # nearly every page has a block at least
    some = drawn(html, sample_blocks).select("html").distinct()
    blocks = stored(some.mapInArrow(_block_texts, "text string").distinct().withColumn("h", F.xxhash64("text")), "blocks")
    rows = sorted(drawn(blocks, sample_blocks).select("h", "text").collect())[:sample_blocks]
    return fit(labelled([r["text"] for r in rows]))


def extract(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for every row of pages.

    The text is the blocks labelled as main text, in page order, joined by line feeds; empty if there are none. A null
    html is an empty page. Repeated rows are read one by one; ids and urls may be null. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_pieces(batches, 2, BATCH_BYTES):
            texts, counts, mains = [], [], []
            for html in batch.column(2):
                blocks = parse(html.as_py()).blocks
                main = [b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y]
                texts.append("\n".join(main))
                counts.append(len(blocks))
                mains.append(len(main))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array(mains, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long, n_blocks long, n_main long")
