"""Main text of web pages by equivalence-class template deduction over the pages of a host.

The tokens of a page are its elements, told apart by their path of tags and names, and its text blocks, told apart by
path and text. A token's occurrence vector says how often it stands on each page of the host; it is kept as a count of
pages, a sum and an exclusive-or of hashes of (page, times). Tokens with one vector form an equivalence class. Paths
make the elements of a class nest by construction. The template of a host holds

- the classes whose elements stand once a page on enough pages: they frame the page, and a text block that has the
  vector of its element, where this is of such a class, is part of the frame as well (the element never says else);
- classes of elements that repeat within a page, all inside one named element: records, such as comments.

The slots are what is left between the elements of the frame. The main one is the deepest container of a class of two
or more that holds at least half of the text of all slots of the host, outside links (widened to the article or main
element around it, where there is one). A page's main text is its text in the main slot, without frame text, without
records, and without elements that are never an article by their tag or by a whole class, id or role name. Pages that
lack the main container, and hosts without a template, fall back on the container that holds half of the page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import drop, prepare, save

# Element names and class words as HTML pages use them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object select option".split())
NEVER = RAW | frozenset("head nav header footer aside button menu".split())
#: Elements that are never part of an article unless they hold it, and those that are not while they are outside one.
WRAPS, HEADS = frozenset("form fieldset dialog".split()), frozenset({"header"})
CONTAINERS = frozenset("html body main article section div td table center".split())
SEMANTIC = frozenset("article main".split())
#: Elements that no class word marks: what they hold is the page or its article.
WHOLE = SEMANTIC | frozenset("html body".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus dialog foot footer header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promotion recommended search sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say what a container is for, and nothing of a paragraph, a title or a quotation with such a name.
CONTAINER_WORDS = frozenset("dialog foot footer header login masthead menu modal notice notices overlay search social widget".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address caption".split())
#: Levels of elements that are told apart, as in browsers: deeper ones count for the last.
DEEPEST = 512
#: Elements that an opening tag of the same group ends where it stands directly in one.
ENDS = {"p": BLOCKS - {"body", "html", "head"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}

#: Share of a host's pages that a class of the frame is on; share of the text that the main slot holds; pages from which
#: text and records count as template; elements of a record.
SUPPORT, HOLDS, ENOUGH, RECORD = 0.5, 0.5, 8, 3

#: What begins a tag, and what matters within one.
OPENING, WITHIN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))"), re.compile("[>\"']")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Numbers in names, as of posts: they tell pages apart and not elements.
LONG = re.compile(r"\d{3,}")

Block = tuple[str, bool, int, str]


class Tags:
    """Tags of a page from left to right. What has no end is text; no place is looked at again for an end in vain, so the
    work grows with the page, whatever stands in it."""

    def __init__(self, page: str):
        self.page, self.last, self.vain, self.endless = page, page.rfind(">"), set(), set()
        self.quotes = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """Place after the ">" of a tag whose attributes begin at `at`; 0 if it has none."""
        seen = []
        while at <= self.last:
            m = WITHIN.search(self.page, at)
            if m[0] == ">":
                return m.end()
            if m.start() in self.vain or m.start() == self.quotes[m[0]]:
                break
            seen.append(m.start())
            at = self.page.find(m[0], m.end()) + 1
        self.vain.update(seen)
        return 0

    def find(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) of the next tag; comments have no name."""
        while m := OPENING.search(self.page, at):
            if m[0] == "<!--":
                end = self.page.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(self.page), "", False, ""
            if m[2] is None:
                end = self.page.find(">", m.end()) + 1 if m.end() <= self.last else 0
            else:
                end = self.end(m.end())
            if end:
                return m.start(), end, (m[2] or "").lower(), bool(m[1]), self.page[m.end() : end - 1]
            at = m.start() + 1
        return None

    def after_raw(self, name: str, at: int) -> int:
        """Place after the closing tag of raw text; 0 if there is none."""
        if name not in self.endless and (m := re.compile(rf"</{re.escape(name)}\b", re.I).search(self.page, at)) and m.end() <= self.last:
            return self.page.find(">", m.end()) + 1
        self.endless.add(name)
        return 0


class Open:
    """An open element: its tag, path, whether it or one around it is never part of an article, the elements around it
    that may yet turn out to wrap the article, and whether it lies in an article."""

    def __init__(self, name: str, path: str, never: bool, wraps: tuple[int, ...], inside: bool):
        self.name, self.path, self.never, self.wraps, self.inside = name, path, never, wraps, inside


def parsed(page: str) -> tuple[list[tuple[str, bool, bool]], list[Block]]:
    """Structural elements opened (path, never part of an article, directly above it the same), and the text blocks
    (path of the innermost structural element, never part of an article, characters in links, text).

    A form, a set of fields or a dialog holds the article, and is none of the parts to drop, if an article or main
    element is in it, or two paragraphs and half of the text that may be the article's.
    """
    root = Open("", "", False, (), False)
    stack: list[Open] = []
    beyond: dict[str, int] = {}
    opened: list[tuple[Open, Open]] = []
    found: list[tuple[Open, int, str]] = []
    # of every form, field set and dialog: articles and paragraphs in it, characters
    held: list[list[int]] = []
    words: list[str] = []
    linked, link = 0, 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            here = stack[-1] if stack else root
            found.append((here, linked, text))
            if not here.never:
                for k in here.wraps:
                    held[k][2] += len(text)
        words.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            words.append(raw)
            linked += len(raw.strip()) if link else 0

    pieces: list[str] = []

    def spill() -> None:
        if pieces:
            take(entities.unescape("".join(pieces)))
            pieces.clear()

    tags = Tags(page)
    while True:
        tag = tags.find(at)
        pieces.append(page[at : tag[0] if tag else len(page)])
        if not tag:
            break
        _, at, name, closes, attributes = tag
        alone = attributes.rstrip().endswith("/")
        if not name:
            continue
        if name == "a":
            spill()
            link = 0 if closes else 1
            continue
        if name in RAW and not closes:
            if not alone:
                at = tags.after_raw(name, at) or (len(page) if name in ("script", "style") else at)
            pieces.append(" ")
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in BLOCKS:
            continue
        spill()
        flush()
        link = 0
        if closes:
            if beyond.get(name):
                beyond[name] -= 1
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    beyond.clear()
                    break
            continue
        while stack and name in ENDS.get(stack[-1].name, ()):
            stack.pop()
        if name in VOID:
            continue
        above = stack[-1] if stack else root
        if len(stack) == DEEPEST:
            if not alone:
                beyond[name] = beyond.get(name, 0) + 1
            continue
        names = sorted({LONG.sub("#", w) for x in NAMES.findall(attributes) for w in "".join(x[1:]).lower().split()}) if attributes else []
        telling = WORDS - CONTAINER_WORDS if name in TEXTUAL or (name in HEADS and above.inside) else WORDS
        own = (name in NEVER and not (name in HEADS and above.inside)) or (name not in WHOLE and any(w in telling for w in names))
        wraps = above.wraps
        if name in WRAPS:
            wraps = (*wraps, len(held))
            held.append([0, 0, 0])
        elif (name in SEMANTIC or name == "p") and not (above.never or own):
            for k in wraps:
                held[k][name == "p"] += 1
        here = Open(name, f"{above.path}/{name}{''.join('.' + w for w in names)}", above.never or own, wraps, above.inside or name in SEMANTIC)
        opened.append((here, above))
        if not alone:
            stack.append(here)
    spill()
    flush()
    total = sum(len(text) for here, _, text in found if not here.never)
    holds = [bool(articles) or (paragraphs >= 2 and chars >= HOLDS * total) for articles, paragraphs, chars in held]
    never = lambda e: e.never or not all(holds[k] for k in e.wraps)
    return [(here.path, never(here), never(above)) for here, above in opened], [(here.path, never(here), n, text) for here, n, text in found]


def tag_of(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def text_token(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}", 1) - (1 << 63)


def tokens(page: str) -> tuple[dict[str, list[int]], dict[int, list]]:
    """{path of an element: [times opened, characters of text in it outside links]} and {text token: [times, path,
    characters outside links]}, without what is never part of an article."""
    opened, found = parsed(page)
    out: dict[str, list[int]] = {}
    said: dict[int, list] = {}
    for path, never, _ in opened:
        if not never:
            out.setdefault(path, [0, 0])[0] += 1
    for path, never, linked, text in found:
        if never:
            continue
        said.setdefault(text_token(path, text), [0, path, max(0, len(text) - linked)])[0] += 1
        while path:
            if path in out:
                out[path][1] += max(0, len(text) - linked)
            path = path.rpartition("/")[0]
    return out, said


def best_alone(page: str) -> str:
    """Main container of a page by itself."""
    got = {p: v for p, v in tokens(page)[0].items() if tag_of(p) in CONTAINERS}
    total = max((v[1] for v in got.values()), default=0)
    ok = [(tag_of(p) in SEMANTIC, p.count("/"), p) for p, v in got.items() if v[0] == 1 and total and v[1] >= HOLDS * total]
    return max(ok, default=(False, 0, ""))[2]


def main_text(page: str, main: str | None, frame: frozenset[int], records: tuple[str, ...] = ()) -> str:
    """Text blocks of `page` inside `main` (found anew where the page has none), but for never-article parts, text
    tokens in `frame` and what is inside `records`."""
    opened, found = parsed(page)
    if not main or not any(p == main and not never for p, never, _ in opened):
        main = best_alone(page)
    inside = main + "/"
    out = []
    for path, never, _, text in found:
        if never or not (path == main or path.startswith(inside)):
            continue
        if any(path == r or path.startswith(r + "/") for r in records) or (frame and text_token(path, text) in frame):
            continue
        out.append(text)
    return "\n".join(out)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


VECTOR = ("pages", "total", "mixed")


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, path, text (whether the token is a text block), its vector (pages, total, mixed), most (times on a
    page), once (whether never more than once), chars (in all) of every token of every host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, *own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                elements, said = tokens(own[2] or "")
                page = repr(own).encode()
                marks = {n: xxhash.xxh64_intdigest(page, n) - (1 << 63) for n in {v[0] for v in (*elements.values(), *said.values())}}
                rows += [(host, xxhash.xxh64_intdigest(p, 2) - (1 << 63), p, False, n, marks[n], chars) for p, (n, chars) in elements.items()]
                rows += [(host, k, p, True, n, marks[n], n * chars) for k, (n, p, chars) in said.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "token", "path", "text", "n", "mark", "chars"])

    own = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = own.mapInArrow(run, "host string, token long, path string, text boolean, n long, mark long, chars long")
    low = F.col("mark").bitwiseAND(F.lit((1 << 30) - 1))
    return rows.groupBy("host", "token", "path", "text").agg(
        F.count("*").alias("pages"), F.sum(low).alias("total"), F.bit_xor("mark").alias("mixed"), F.max("n").alias("most"), F.sum("chars").alias("chars"))


def ancestors(path: Column) -> Column:
    """The path itself and those of the elements around it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def templates(pages: DataFrame) -> DataFrame:
    """host, main (path of the main slot), frame (text tokens of the template), records (paths of record elements)."""
    seen = occurrences(pages)
    # a text block on few pages is no template, and most are on one
    seen = save(seen.where(~F.col("text") | (F.col("pages") >= ENOUGH)), "tokens")
    elements = seen.where("not text").drop("text", "token")
    whole = elements.groupBy("host").agg(F.max("pages").alias("all_pages"))
    key = ["host", *VECTOR]
    tag, depth = F.regexp_extract("path", r"([^/.]+)[^/]*$", 1), F.size(F.split("path", "/"))
    once = elements.where("most = 1").join(whole, "host").where(F.col("pages") >= SUPPORT * F.col("all_pages"))
    classes = save(once.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1"), "classes")
    members = once.join(classes, key, "left_semi")
    frame = seen.where("text").join(members.select(*key, "path"), [*key, "path"], "left_semi").select("host", "token", "path", "chars")
    frame = save(frame, "frame")
    # what a container holds in slots is its text less the frame's
    fixed = frame.select("host", "chars", F.explode(ancestors(F.col("path"))).alias("path")).groupBy("host", "path").agg(F.sum("chars").alias("fixed"))
    holds = members.join(fixed, ["host", "path"], "left").withColumn("free", F.col("chars") - F.coalesce("fixed", F.lit(0)))
    top = holds.groupBy("host").agg(F.max("free").alias("all_free")).where("all_free > 0")
    holds = save(holds.where(tag.isin(*CONTAINERS)).select("host", "path", "free"), "holds")
    best = holds.join(top, "host").where(F.col("free") >= HOLDS * F.col("all_free")).groupBy("host").agg(F.max(F.struct(depth.alias("depth"), "path")).alias("best"))
    around = best.select("host", F.posexplode(ancestors(F.col("best.path"))).alias("depth", "path"))
    named = around.where(tag.isin(*SEMANTIC)).join(holds.select("host", "path"), ["host", "path"]).groupBy("host").agg(F.max(F.struct("depth", "path")).alias("named"))
    main = best.join(named, "host", "left").select("host", F.coalesce("named.path", "best.path").alias("main"))
    again = elements.where((F.col("most") > 1) & (F.col("pages") >= ENOUGH)).groupBy(*key).agg(F.count("*").alias("members"), F.min(F.struct(depth.alias("depth"), "path")).alias("head"), F.collect_set("path").alias("paths"))
    head = F.col("head.path")
    inside = F.forall("paths", lambda p: (p == head) | p.startswith(F.concat(head, F.lit("/"))))
    records = again.where(F.col("members") >= RECORD).where(inside & head.rlike(r"/(div|li|section|article)\.[^/]*$"))
    records = records.groupBy("host").agg(F.array_sort(F.collect_set(head)).alias("records"))
    texts = frame.groupBy("host").agg(F.array_sort(F.collect_set("token")).alias("frame"))
    out = save(main.join(texts, "host", "left").join(records, "host", "left").select("host", "main", "frame", "records"), "templates")
    drop(seen, classes, frame, holds)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`.

    Null and empty html give an empty text; a null or odd url belongs to the host without a name; repeated rows are
    extracted each; other columns are not looked at; no rows give no rows.
    """
    prepare(pages.sparkSession)
    own = pages.select("page_id", "url", host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    both = own.join(templates(pages), "host", "left").select("page_id", "url", "html", "main", "frame", "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column(k).to_pylist() for k in range(2, 6))
            texts = [main_text(h or "", main, frozenset(frame or ()), tuple(records or ())) for h, main, frame, records in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(own.dtypes)
    return both.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
