"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

Tokens are tags told apart by their path of enclosing containers (names, classes, ids). A token's occurrence vector holds
its count on each page of the host; it is kept as a number of pages, a number of occurrences and a sum of hashes of
(page, count), so that equal vectors have equal keys and partial sums can be combined anywhere. Tokens of a host with equal
vectors form an equivalence class; a class is valid for the template if it occurs on enough of the host's pages and its
tokens nest in the tokens of one parent class or of the class itself. Classes whose tokens stand once on each page are
the skeleton. The main slot of the host is an article (or main) element of the skeleton, else the deepest container of
the skeleton whose subtree still holds ``NEARLY`` all text outside links that no menu, header, footer, sidebar, notice,
advert, form or comment role forbids. Text that is the same on all pages which have some at its path is the template's
own and is not counted, unless the host has no other.

A host's template is short whatever its number of pages (tags on at least half of them), so templates go to the pages by
broadcast if their checked number is small, else by a join that splits hosts over ``SALTS`` keys. No page is grouped by host.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones left
out, and the others joined by blank lines in page order. Nothing else is dropped or cut.

Defined cases: null or empty html gives an empty text; a page without a host belongs to the host ""; a page that lacks its
host's main slot is read by its own article, main element or the deepest container that holds nearly all its text; text outside any element belongs to the body;
unclosed elements end with their container, stray end tags are ignored; repeated rows give equal rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.storage import bounded, keep

BROADCAST_HOSTS = 100_000
SALTS = 64
NEARLY = 0.95
# Names of HTML elements and of roles.
CONTAINERS = set("html head body div section article main header footer nav aside form ul ol dl table figure dialog details fieldset menu".split())
BLOCKS = CONTAINERS | set("p li dt dd tr td th thead tbody tfoot caption h1 h2 h3 h4 h5 h6 blockquote pre figcaption hr address hgroup summary center".split())
HIDDEN = set("script style noscript template textarea iframe svg math select button object title canvas audio video".split())
NOT_MAIN = set("head nav footer aside form dialog menu".split())
ROLES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert comment comments reply replies respond "
    "disqus sidebar side menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe signup login popup modal overlay footer "
    "masthead topbar widget widgets pagination pager toolbar paywall".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HOST = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _element(name: str, attributes: str) -> str:
    """An element as a step of a path: its name, then its classes and id."""
    if not attributes or "=" not in attributes:
        return name
    names = [w for m in _NAMED.finditer(attributes) for w in sorted((m[2] or m[3] or m[4] or "").lower().split())]
    return ".".join([name, *(n.replace("/", "") for n in names if not any(c.isdigit() for c in n))])


def walk(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", path, element) for tags that take part in the template and ("text", path, text) for blocks, in order;
    ("link", path, text) repeats what stood inside links."""
    stack: list[str] = []
    names: list[str] = []
    text: list[str] = []
    link: list[str] | None = None
    at, size = 0, len(page)

    def flush() -> Iterator[tuple[str, str, str]]:
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            yield "text", "/".join(stack), block

    while at < size:
        tag = _TAG.search(page, at)
        end = tag.start() if tag else size
        if end > at:
            part = html.unescape(page[at:end])
            text.append(part)
            if link is not None:
                link.append(part)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing = bool(tag[1])
        if name in HIDDEN:
            if not closing and not tag[3].rstrip().endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else size
            text.append(" ")
        elif name == "br":
            text.append(" ")
        elif name == "a":
            if link:
                yield "link", "/".join(stack), "".join(link)
            link = None if closing else []
        elif name in BLOCKS:
            yield from flush()
            if name in CONTAINERS:
                if closing:
                    if name in names:
                        while names.pop() != name:
                            stack.pop()
                        stack.pop()
                else:
                    stack.append(_element(name, tag[3]))
                    names.append(name)
                    yield "open", "/".join(stack), name
            elif not closing:
                yield "open", "/".join([*stack, name]), name
    yield from flush()


def forbidden(step: str, inside_main: bool) -> bool:
    """Whether an element of a path has a role outside the main text."""
    name, *named = step.split(".")
    if name in ("html", "body"):
        return False
    roles = {part for n in named for part in (n, *re.split(r"[-_]", n))}
    if name in ("article", "main"):
        return bool(roles & {"ad", "ads", "advert", "comment", "comments", "promo", "related"})
    return name in NOT_MAIN or name == "header" and not inside_main or bool(roles & ROLES) or "header" in named and not inside_main


def allowed(path: str, main: str = "") -> bool:
    """Whether no element of a path below ``main`` has a forbidden role."""
    steps, inside = path.split("/"), False
    for i, step in enumerate(steps):
        below = i >= (main.count("/") + 1 if main else 0)
        if below and forbidden(step, inside):
            return False
        inside = inside or step.split(".")[0] in ("article", "main")
    return True


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, occurrences, vector, around, chars, texts, lo, hi), combined over a batch; token "" counts pages.

    chars: of text directly in a container, outside links and forbidden roles; around: of such text on the pages that hold
    the token; texts: pages with such text; lo, hi: the
    smallest and largest hash of a page's, which are equal if all are.
    """
    permitted: dict[str, bool] = {}
    for batch in batches:
        sums: dict[tuple[str, str], list] = defaultdict(lambda: [0, 0, 0, 0, 0, 0, None, None])
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host, counts, direct, linked = host_of(url), defaultdict(int), defaultdict(list), defaultdict(int)
            for kind, path, value in walk(page or ""):
                if kind == "open":
                    counts[path] += 1
                elif kind == "text":
                    direct[path].append(value)
                else:
                    linked[path] += len(value)
            counts[""] = 1
            seed = xxhash.xxh64_intdigest(f"{url}\x00{page}") >> 1
            around = 0
            for token, blocks in direct.items():
                if token not in permitted:
                    if len(permitted) > 100_000:
                        permitted.clear()
                    permitted[token] = allowed(token)
                chars = sum(map(len, blocks)) - linked[token]
                if permitted[token] and chars > 0:
                    own, hashed = sums[host, token], xxhash.xxh64_intdigest("\n".join(blocks)) >> 1
                    around += chars
                    own[4] += chars
                    own[5] += 1
                    own[6] = hashed if own[6] is None else min(own[6], hashed)
                    own[7] = hashed if own[7] is None else max(own[7], hashed)
            for token, n in counts.items():
                own = sums[host, token]
                own[0] += 1
                own[1] += n
                own[2] += (seed * (2 * n + 1)) % (1 << 40)
                own[3] += around
        names = ["host", "token", "pages", "occurrences", "vector", "around", "chars", "texts", "lo", "hi"]
        columns = zip(*((h, t, *v) for (h, t), v in sums.items()), strict=True) if sums else ([],) * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(columns)], names)


def templates(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """(host, token, class, parent, skeleton, around, varied, chars): the tags of each host's valid equivalence classes.

    chars: of the text in the whole subtree of a container; varied: of that which differs between pages.
    """
    whole = F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector")
    sums = keep(
        pages.select("url", "html").mapInArrow(_token_rows, "host string, token string, pages long, occurrences long, vector long, around long, chars long, texts long, lo long, hi long")
        .groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "occurrences", "around", "chars", "texts")), F.min("lo").alias("lo"), F.max("hi").alias("hi"), whole)
    )
    steps = F.split("token", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat_ws("/", F.slice(steps, 1, i)))
    varied = F.when((F.col("texts") > 1) & (F.col("lo") == F.col("hi")), 0).otherwise(F.col("chars"))
    subtrees = (
        sums.where("token <> '' AND chars > 0").select("host", F.explode(above).alias("token"), varied.alias("varied"), "chars")
        .groupBy("host", "token").agg(F.sum("varied").alias("varied"), F.sum("chars").alias("chars"))
    )
    size = sums.where("token = ''").select("host", F.col("pages").alias("size"))
    frequent = sums.drop("chars").where("token <> ''").join(size, "host").where(F.col("pages") >= F.lit(support) * F.col("size")).join(subtrees, ["host", "token"], "left")
    named = frequent.select(
        "host", "token", F.xxhash64("pages", "occurrences", "vector").alias("class"), (F.col("pages") == F.col("occurrences")).alias("skeleton"), "around",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("varied", "chars")),
        F.regexp_replace("token", "/?[^/]*$", "").alias("above"),
    )
    parents = named.select("host", F.col("token").alias("above"), F.col("class").alias("parent"))
    nested = named.join(parents, ["host", "above"], "left")
    # Valid: besides the class itself, the tokens of a class nest in one other class. The class that stands at the top loses
    # only its tokens within others: a part that stands once inside a repeated one must not take the whole skeleton along.
    other = F.when(F.col("parent") != F.col("class"), F.col("parent"))
    nested = nested.withColumn("other", other)
    valid = nested.groupBy("host", "class").agg(F.min("other").alias("lo"), F.max("other").alias("hi"), F.max(F.col("parent").isNull()).alias("top"))
    valid = valid.where(F.col("top") | F.col("lo").isNull() | (F.col("lo") == F.col("hi"))).select("host", "class", "top")
    tokens = nested.join(valid, ["host", "class"]).where(~F.col("top") | F.col("other").isNull())
    return tokens.select("host", "token", "class", "parent", "skeleton", "around", "varied", "chars")


def _main_slot(tokens: list) -> str:
    """The path of a host's main slot among its skeleton tokens; "" if there is none."""
    open_to = [t for t in tokens if t["skeleton"] and t["token"].rsplit("/", 1)[-1].split(".")[0] in CONTAINERS and allowed(t["token"])]
    for wanted in ("article", "main"):
        own = [t["token"] for t in open_to if t["token"].rsplit("/", 1)[-1].split(".")[0] == wanted]
        if own:
            return min(own, key=lambda p: (p.count("/"), p))
    for text in ("varied", "chars"):
        if any(t[text] > 0 for t in open_to):
            # Shares of the text on the pages that hold the container, so that pages of another layout do not count against it.
            return _deepest({t["token"]: t[text] / max(1, t["around"]) for t in open_to})
    return ""


def _deepest(size: dict[str, int]) -> str:
    """The deepest of the containers whose subtree holds nearly all text, by its size or share."""
    most = max(size.values())
    return max((p for p in size if size[p] >= NEARLY * most), key=lambda p: (p.count("/") + bool(p), size[p], p))


def _page_slot(blocks: list[tuple[str, str]], opened: dict[str, int], linked: dict[str, int]) -> str:
    """The main slot of a page by itself: its first article or main element, else the deepest container that stands once
    and holds nearly all text; "" is the whole page."""
    for wanted in ("article", "main"):
        own = [p for p in opened if p.rsplit("/", 1)[-1].split(".")[0] == wanted and allowed(p)]
        if own:
            return min(own, key=lambda p: (p.count("/"), p))
    direct: dict[str, int] = defaultdict(int)
    for path, block in blocks:
        direct[path] += len(block)
    size: dict[str, int] = defaultdict(int, {"": 0})
    for path, chars in direct.items():
        if allowed(path):
            steps = path.split("/") if path else []
            for above in ("", *("/".join(steps[: i + 1]) for i in range(len(steps)))):
                size[above] += max(0, chars - linked[path])
    return _deepest({p: n for p, n in size.items() if not p or opened[p] == 1}) if size[""] else ""


def main_text(page: str | None, main: str) -> str:
    """The text of a page's main slot."""
    blocks, opened, linked = [], defaultdict(int), defaultdict(int)
    for kind, path, value in walk(page or ""):
        if kind == "open":
            opened[path] += 1
        elif kind == "text":
            blocks.append((path, value))
        else:
            linked[path] += len(value)
    slot = main if main and main in opened else _page_slot(blocks, opened, linked)
    inside = slot + "/"
    return "\n\n".join(b for p, b in blocks if (not slot or p == slot or p.startswith(inside)) and allowed(p, slot))


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots: dict[str, str] = {}
        out = []
        for url, page, tokens in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), batch.column("tokens"), strict=True):
            host = host_of(url)
            if host not in slots:
                slots[host] = _main_slot(tokens.as_py() or [])
            out.append(main_text(page, slots[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: a row per row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = keep(templates(pages))
    lists = found.groupBy("host").agg(F.collect_list(F.struct("token", "skeleton", "around", "varied", "chars")).alias("tokens"))
    host = F.coalesce(F.lower(F.nullif(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), F.lit(""))
    keyed = pages.withColumn("host", host)
    if bounded(lists, BROADCAST_HOSTS):
        joined = keyed.join(F.broadcast(lists), "host", "left")
    else:
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "tokens").mapInArrow(_text_rows, f"page_id {kind}, url string, text string")
