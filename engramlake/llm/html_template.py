"""HTML extraction by equivalence-class template deduction.

Tokens are the tags of a page, told apart by the path of elements in which they stand, and its text
nodes.  Over the pages of a host each token has an occurrence vector, its count on each page; tokens
with the same vector form an equivalence class.  A class is valid if it occurs on enough pages to be
no coincidence, in one order on all of them, and nests in the root class, that of the page as a
whole; the valid classes are the host's template, everything else is what was put into its slots.
Text that belongs to the template is boilerplate, and the slot in which most other text stands is
the main one.  Pages with the same text count once.

Vectors are compared by a fingerprint that is summed over pages, so a host may own any share of the
pages: its rows are aggregated before and after the shuffle, and no task sees a whole host.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stored

# a quote opens only behind an equals sign; one that is never closed doesn't count
MARKUP = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*>|\?[^>]*>|/?([a-zA-Z][^\s/>]*)([^>=]*(?:=(?:\s*(?:\"[^\"]*\"|'[^']*'))?[^>=]*)*)>)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HEADING = re.compile(r"/h[1-6](?:\.[^/]*)?$")
# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html head caption tbody td tfoot th thead tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# elements that hold no article, by name and by the words of their class, id or role
ASIDE = frozenset("nav header footer aside form button select dialog menu search object audio video canvas map head".split())
ASIDE_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright disqus footer header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
MAIN_WORDS = frozenset("main articlebody article".split())
HEADER_WORDS = frozenset("header masthead".split())


@dataclass
class Block:
    text: str
    path: str
    slots: tuple[int, ...]  # the tags of the elements around it that stand in ``Page.tags``, outermost first
    at: int  # how many tags come before it
    main: bool
    aside: bool
    linked: int = 0


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)  # paths in page order


def _names(attributes: str) -> tuple[str, set[str]]:
    """What tells an element from others of its name, and the words in that."""
    found = [(k.lower(), (a or b or c).strip()) for k, a, b, c in ATTRIBUTE.findall(attributes)]
    words = {w for _, v in found for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", v).lower())}
    words |= {v.lower() for k, v in found if k in ("role", "itemprop")}
    return "".join("." + re.sub(r"\d+", "0", v) for k, v in found if k in ("class", "role")), words


def parse(source: str) -> Page:
    """Blocks of text with decoded character references and single spaces, in page order, and the tags."""
    page, stack, parts, linked = Page(), [], [], 0
    nowhere = ("", "", False, -1)
    # an element on the stack: name, path, whether it is or lies in a main element, its tag
    near = nowhere  # the innermost block element
    mains: list[tuple[int, ...]] = []  # main elements, each with the tags around it and its own
    titles: list[tuple[int, ...]] = []  # h1 likewise
    doubtful: set[int] = set()  # tags of elements that may hold no article

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                top = near if near is not nowhere or not stack else stack[-1]
                page.blocks.append(Block(text, top[1], tuple(e[3] for e in stack if e[0] in BLOCK or e is top), len(page.tags), top[2], False, linked))
        linked = 0

    def cut(depth: int) -> None:
        """Closes the elements from a depth on."""
        nonlocal near, links
        del stack[depth:]
        near = next((e for e in reversed(stack) if e[0] in BLOCK), nowhere)
        links = sum(e[0] == "a" for e in stack)

    at, size, links = 0, len(source), 0
    while at < size:
        m = MARKUP.search(source, at)
        start = m.start() if m else size
        if start > at:
            parts.append(source[at:start])
            linked += start - at if links else 0
        if not m:
            break
        at = m.end()
        if not m[1]:
            continue
        name, block = m[1].lower(), False
        if name in BLOCK:
            block = True
            flush()
        if source[start + 1] == "/":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None:
                continue
            if not block and any(e[0] in BLOCK for e in stack[depth + 1 :]):
                del stack[depth]  # inline markup that was left open over a block
                links = sum(e[0] == "a" for e in stack)
            else:
                cut(depth)
            continue
        if block:
            if near[0] == "p" and name in CLOSES_P:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i] is near))
            if rivals := SIBLINGS.get(name):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in rivals:
                        cut(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
        elif name == "br":
            parts.append(" ")
        mark, words = _names(m[2]) if "=" in m[2] else ("", frozenset())
        path = f"{near[1]}/{name}{mark}"
        page.tags.append(path)
        if name in VOID:
            continue
        if name in RAW:
            if not m[2].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.end() if end else size
            continue
        against = words & ASIDE_WORDS
        itself = name in ("article", "main") or bool(words & MAIN_WORDS) and not against and name not in ASIDE
        main, tag = near[2] or itself, len(page.tags) - 1
        around = (*(e[3] for e in stack), tag)
        # the title of an article may stand in a header of its own, and an article may have any class
        if name == "header" or against and against <= HEADER_WORDS:
            doubt = not near[2]
        elif name in ("article", "main"):
            doubt = bool(against) and any(e[0] == "article" for e in stack)
        else:
            doubt = (name in ASIDE or bool(against)) and name not in ("html", "body")
        if doubt:
            doubtful.add(tag)
        if itself:
            mains.append(around)
        elif name == "h1":
            titles.append(around)
        stack.append(element := (name, path, main, tag))
        if block:
            near = element
        links += name == "a"
    flush()
    if doubtful:
        _set_aside(page, mains, titles, doubtful)
    return page


def _set_aside(page: Page, mains: list[tuple[int, ...]], titles: list[tuple[int, ...]], doubtful: set[int]) -> None:
    """Marks the blocks in doubtful elements, unless such an element is a wrapper of the page.

    It is one if it holds every main element, or more than half of the text and every h1."""
    size: dict[int, int] = {}
    for b in page.blocks:
        for tag in b.slots:
            size[tag] = size.get(tag, 0) + len(b.text)
    half = sum(len(b.text) for b in page.blocks) / 2
    aside = {d for d in doubtful if not (mains and all(d in m for m in mains) or size.get(d, 0) > half and not mains and all(d in t for t in titles))}
    for b in page.blocks:
        b.aside = not aside.isdisjoint(b.slots)


@lru_cache(maxsize=1 << 16)
def tag_hash(path: str) -> int:
    return token_hash("tag", path)


def token_hash(kind: str, what: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {what}") - (1 << 63)


def text_token(b: Block) -> int:
    return token_hash("text", f"{b.path} {b.text}")


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user or port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """host, body, tags, texts, at, up, chars: each page's tokens in page order, without repeated bodies.

    For each text node: how many tags come before it, which tag is the innermost element around it
    that has a slot (-1: none), and the characters it may give an article, which are none in what is
    set aside.  Bodies are told apart by their text that isn't set aside, and one of each is kept."""
    names = ["host", "body", "tags", "ups", "texts", "at", "up", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for host, source in rows_of([batch], "host", "html"):
                page = parse(source or "")
                if not page.blocks:
                    continue
                ups = [-1] * len(page.tags)
                for b in page.blocks:
                    for outer, inner in zip(b.slots, b.slots[1:]):
                        ups[inner] = outer
                body = token_hash("body", "\n".join(b.text for b in page.blocks if not b.aside))
                row = (host, body, [tag_hash(t) for t in page.tags], ups, [text_token(b) for b in page.blocks], [b.at for b in page.blocks], [b.slots[-1] if b.slots else -1 for b in page.blocks], [0 if b.aside else max(0, len(b.text) - 2 * b.linked) for b in page.blocks])
                for c, v in zip(cols, row):
                    c.append(v)
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            kinds = (pa.int64(), pa.int64(), longs, ints, longs, ints, ints, ints)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    keyed = pages.select(F.xxhash64(host_of(F.col("url"))).alias("host"), "html")
    rows = keyed.mapInArrow(run, "host long, body long, tags array<long>, ups array<int>, texts array<long>, at array<int>, up array<int>, chars array<int>")
    return rows.dropDuplicates(["host", "body"])


def frequent(bodies: DataFrame, *, share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """host, token, kind (0: tag, 1: text node), class_id, pages, of, place, most: the frequent tokens.

    Frequent: on ``least_pages`` bodies and on the ``share`` of the host's bodies, by which a host has
    at most 1 / share times the tokens of its average page.  Tokens of a class share their number of
    bodies and the fingerprint of their occurrence vector."""
    names = ["host", "body", "token", "kind", "n", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for host, body, tags, texts, at in rows_of([batch], "host", "body", "tags", "texts", "at"):
                # the first places; text nodes between the same two tags stand in their own order
                first = {t: i for i, t in zip(range(len(tags) - 1, -1, -1), reversed(tags))}
                after = {t: k - 0.9 + 0.8 * j / len(texts) for j, k, t in zip(range(len(texts) - 1, -1, -1), reversed(at), reversed(texts))}
                rows = [(0, 2, 1, -1.0), *((t, 0, n, float(first[t])) for t, n in Counter(tags).items()), *((t, 1, n, after[t]) for t, n in Counter(texts).items())]
                cols[0] += [host] * len(rows)
                cols[1] += [body] * len(rows)
                for c, values in zip(cols[2:], zip(*rows)):
                    c += values
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 5, pa.float64()))], names=names)

    seen = bodies.mapInArrow(run, "host long, body long, token long, kind long, n long, place double")
    tokens = seen.groupBy("host", "token").agg(F.first("kind").alias("kind"), F.count("*").alias("pages"), *[F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k), "body", "n"), 32)).alias(f"vector{k}") for k in (0, 1)], F.avg("place").alias("place"), F.max("n").alias("most")).filter(F.col("pages") >= least_pages)
    tokens = stored(tokens, "tokens")
    sizes = tokens.filter("kind = 2").select("host", F.col("pages").alias("of"))
    tokens = tokens.join(sizes, "host").filter((F.col("kind") < 2) & (F.col("pages") >= share * F.col("of")))
    return tokens.select("host", "token", "kind", F.xxhash64("pages", "vector0", "vector1").alias("class_id"), "pages", "of", "place", "most")


def longest_rise(seq: list[int]) -> set[int]:
    """The places of a longest increasing subsequence."""
    tails, at, before = [], [], [-1] * len(seq)
    for i, v in enumerate(seq):
        k = bisect_left(tails, v)
        if k:
            before[i] = at[k - 1]
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = set(), at[-1] if at else -1
    while i >= 0:
        out.add(i)
        i = before[i]
    return out


class Known(NamedTuple):
    """A frequent token of a host."""

    token: int
    kind: int
    class_id: int
    pages: int
    of: int
    place: float
    most: int


class Judge:
    """Checks bodies of one host against its classes: order within each, place in the root, text in slots.

    A class's order is that of its tokens' average places; a token that stands elsewhere on any body
    is out of order.  The root class holds the tokens that every body has once."""

    def __init__(self, known: list):
        classes: dict[int, list] = {}
        for t in known:
            classes.setdefault(t.class_id, []).append(t)
        self.rank = {t.token: (c, i, len(ts)) for c, ts in classes.items() for i, t in enumerate(sorted(ts, key=lambda t: (t.place, t.token)))}
        self.root = {t.token for t in known if t.pages == t.of and t.most == 1}
        self.constant = {t.token for t in known if t.kind == 1}
        self.tags = {t.token for t in known if t.kind == 0}

    def __call__(self, tags: list[int], ups: list[int], texts: list[int], at: list[int], up: list[int], chars: list[int], found: dict[int, list]) -> None:
        """Adds to ``found``: for each token whether it was out of order, its least and greatest gap
        in the root, and the characters of text within it that aren't constant."""
        order, k = [], 0
        for i in range(len(tags) + 1):
            while k < len(texts) and at[k] <= i:
                if texts[k] in self.constant:
                    order.append(texts[k])
                k += 1
            if i < len(tags) and tags[i] in self.tags:
                order.append(tags[i])
        times: Counter = Counter()
        runs: dict[int, tuple[list[int], list[int]]] = {}
        for n, t in enumerate(order):
            c, i, size = self.rank[t]
            seq, where = runs.setdefault(c, ([], []))
            seq.append(times[t] * size + i)
            where.append(n)
            times[t] += 1
        out: set[int] = set()
        for seq, where in runs.values():
            if any(a >= b for a, b in zip(seq, seq[1:])):
                out |= {where[i] for i in set(range(len(seq))) - longest_rise(seq)}
        gap = 0
        for n, t in enumerate(order):
            one = found.setdefault(t, [False, gap, gap, 0])
            one[0] |= n in out
            one[1], one[2] = min(one[1], gap), max(one[2], gap)
            if t in self.root and n not in out:
                gap = self.rank[t][1] + 1
        for t, u, n in zip(texts, up, chars):
            if n and t not in self.constant:
                while u >= 0:
                    if tags[u] in self.root:
                        found[tags[u]][3] += n
                    u = ups[u]
                if 0 in found:
                    found[0][3] += n
                else:
                    found[0] = [False, 0, 0, n]


def host_templates(bodies: DataFrame, tokens: DataFrame, *, held_tokens: int = 200_000, most_of: float = 0.8) -> DataFrame:
    """host, constant (text tokens of the template), main (the slot of the article).

    The tokens of a class are valid that stand in the class's order on every body, and those of other
    classes than the root only if they lie in the same gap between two tokens of the root wherever
    they occur.  The main slot is the innermost element of the root that holds ``most_of`` the text
    that isn't constant and not set aside.  Up to ``held_tokens`` tokens are handed to every task,
    more are joined."""
    columns = ["tags", "ups", "texts", "at", "up", "chars"]
    one = F.struct("token", "kind", "class_id", "pages", "of", "place", "most")
    held: dict[int, list[Known]] | None = None
    if tokens.count() <= held_tokens:
        held, rows = {}, bodies
        for host, *known in tokens.select("host", one.alias("t")).select("host", "t.*").toLocalIterator():
            held.setdefault(host, []).append(Known(*known))
    else:
        rows = bodies.join(tokens.groupBy("host").agg(F.collect_list(one).alias("known")), "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges: dict[int, Judge] = {}
        found: dict[int, dict[int, list]] = {}
        rows = 0

        def table_of() -> pa.RecordBatch:
            made = [(h, t, *v) for h, f in found.items() for t, v in f.items()]
            cols = list(zip(*made)) if made else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "token", "out", "least", "greatest", "chars"])

        for batch in batches:
            hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
            known = None if held is not None else batch.column(batch.schema.get_field_index("known"))
            if len(judges) > 2000:
                judges.clear()
            for i, h in enumerate(hosts):
                if h not in judges:
                    judges[h] = Judge(held.get(h, []) if held is not None else [Known(**k) for k in known[i].as_py()])
            for h, *row in rows_of([batch], "host", *columns):
                judge = judges[h]
                if not judge.rank:
                    continue
                before = len(f := found.setdefault(h, {}))
                judge(*row, f)
                rows += len(f) - before
            if rows > 100_000:
                yield table_of()
                found.clear()
                rows = 0
        yield table_of()

    judged = rows.mapInArrow(run, "host long, token long, out boolean, least long, greatest long, chars long")
    judged = judged.groupBy("host", "token").agg(F.max("out").alias("out"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("chars").alias("chars"))
    total = judged.filter("token = 0").select("host", F.col("chars").alias("total"))
    root = (F.col("pages") == F.col("of")) & (F.col("most") == 1)
    valid = tokens.join(judged, ["host", "token"]).filter(~F.col("out") & (root | (F.col("least") == F.col("greatest")))).join(total, "host", "left")
    slot = F.when((F.col("kind") == 0) & root & (F.col("chars") >= most_of * F.col("total")), F.struct("place", "token"))
    return valid.groupBy("host").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.col("token")))).alias("constant"), F.max(slot)["token"].alias("main"))


def extract(source: str, constant: set[int], main: int | None) -> str:
    """The text of the article of one page.

    What is set aside is dropped everywhere.  Of what doesn't belong to the template, what stands in
    the host's main slot is kept; main elements stand for it where they hold at least half of its
    text on this page, or where there is no slot, and without both everything is kept.  Text of the
    template stays if it belongs to the flow of what is kept."""
    page = parse(source)
    every = [b for b in page.blocks if not b.aside]
    own = [text_token(b) not in constant for b in every]

    def in_slot(b: Block) -> bool:
        return main is not None and any(tag_hash(page.tags[s]) == main for s in b.slots)

    slot = [b for b, fresh in zip(every, own) if fresh and in_slot(b)]
    hinted = [b for b, fresh in zip(every, own) if fresh and b.main]
    if slot and 2 * sum(len(b.text) for b in slot if b.main) < sum(len(b.text) for b in slot):
        hinted = []
    if not hinted and not slot:
        return "\n".join(b.text for b, fresh in zip(every, own) if fresh)
    zone = [(b, fresh) for b, fresh in zip(every, own) if (b.main if hinted else in_slot(b))]
    return "\n".join(b.text for b, kept in zip((b for b, _ in zone), _flow(zone)) if kept)


def _flow(zone: list[tuple[Block, bool]]) -> list[bool]:
    """Which blocks of the main slot stay: a page's own, and of those that pages share the ones in their flow.

    Repetition alone doesn't make a subheading boilerplate.  Shared text stays if it isn't mostly
    links, stands in the element that holds own text, and has own text behind it and, unless it is a
    heading, before it."""
    first = next(k for k, (_, fresh) in enumerate(zone) if fresh)
    last = max(k for k, (_, fresh) in enumerate(zone) if fresh)
    holders = {b.slots[-2:-1] for b, fresh in zone if fresh}

    def stays(k: int, b: Block) -> bool:
        between = k < last and (k > first or HEADING.search(b.path) is not None)
        return between and b.slots[-2:-1] in holders and 2 * b.linked <= len(b.text)

    return [fresh or stays(k, b) for k, (b, fresh) in enumerate(zone)]


def main_text(pages: DataFrame, *, broadcast_rows: int = 100_000, **options) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of ``pages(page_id, url, html)``.

    Null or empty html has an empty text, a page without a host shares the template of those like
    it, and repeated rows are rows of their own.  Other columns are ignored.  The templates are
    handed to every task while they number at most ``broadcast_rows`` hosts; more are joined."""
    bodies = stored(parsed(pages), "bodies")
    known = stored(host_templates(bodies, stored(frequent(bodies, **options), "frequent")), "templates")
    schema = "page_id long, url string, text string, n_chars long"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(host_of(F.col("url"))).alias("host"))
    tokens = known.agg(F.count("*"), F.coalesce(F.sum(F.size("constant")), F.lit(0))).first()
    if tokens[0] <= broadcast_rows and tokens[1] <= 10 * broadcast_rows:
        held = {r.host: (set(r.constant), r.main) for r in known.collect()}
    else:
        held, rows = None, rows.join(known, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts = [], [], []
            if held is not None:
                these = ((i, u, s, *held.get(h, (set(), None))) for i, u, s, h in rows_of([batch], "page_id", "url", "html", "host"))
            else:
                these = ((i, u, s, set(c or ()), m) for i, u, s, c, m in rows_of([batch], "page_id", "url", "html", "constant", "main"))
            for page_id, url, source, constant, main in these:
                ids.append(page_id)
                urls.append(url)
                texts.append(extract(source or "", constant, main))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)
