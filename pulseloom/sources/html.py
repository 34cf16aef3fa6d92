"""Community pages to posts: elements in document order, read by class names, behind Arrow batches.

HTML has no built-in reader; pages are parsed in ``mapInArrow``, a page a row and a few megabytes at a time, and only structs leave the worker.
A page that cannot be parsed fails alone: ``page_errors`` returns it with its reason.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import slices
from ..functions.parse import canonical_url, document_id
from ..functions.text import content_hash
from ..functions.text import tidy as tidy_column
from ..functions.timefn import absolute_datetime
from ..operators.posts import evidence
from ..schemas import POST

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))

# Class names of the two page layouts, matched as parts of the class attribute.
TITLE = ("title", "np_18px", "b_title", "bd_title", "subject")
BODY = ("rd_body", "read_body", "bd_doc")
COMMENT = ("cmt_item", "fdb_itm")
COMMENT_BODY = ("comment_body", "cmt_content", "comment-body", "rd_cmt", "comment_content", "comment-content", "xe_content")
VIEWS = ("views", "read", "view_cnt", "bd_view", "read_cnt", "bd_cnt")
LIKES = ("recommend", "recommends", "like", "bd_vote", "recommend_cnt", "vote")
COUNTS = ("comments-count", "comment-count", "cmt_count", "reply_cnt", "comment_cnt")
DATES = ("date", "time", "regdate", "published")
_SIMPLE_COUNTS = (("views", "views"), ("recommends", "recommendations"), ("comments-count", "comment_count"))
DELETED = r"삭제된\s*(?:게시|글)|존재하지\s*않는\s*게시|글이\s*없|글을\s*찾을\s*수\s*없"
#: Bytes of pages that a worker parses at a time: posts as Python objects are several times as large.
_SLICE = 1 << 20
#: Characters of a count, a time or a name, at most.
_SHORT = 256
_ABSOLUTE = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})", re.ASCII)


class Page(HTMLParser):
    """A page as arrays, elements in document order: ``end`` is the element after an element's last inner one, ``lo`` and ``hi`` bound its strings.

    What an element takes from those around it is carried from parent to child in one pass, so that the work is linear however deep the markup is. A link closes an open link.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parent, self.lo, self.hi, self.end = [""], [{}], [-1], [0], [0], [0]
        self.strings: list[str] = []
        self.holder: list[int] = []
        self._open, self._count = [0], Counter()
        self.feed(html or "")
        self.close()
        while self._open:
            self._pop()
        self._chars = [0, *accumulate(map(len, self.strings))]
        self._inked = [0, *accumulate(bool(tidy(x)) for x in self.strings)]

    def _pop(self) -> str:
        i = self._open.pop()
        self.hi[i], self.end[i] = len(self.strings), len(self.tags)
        self._count[self.tags[i]] -= 1
        return self.tags[i]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.handle_endtag("a")
        i = len(self.tags)
        for column, value in ((self.tags, tag), (self.attrs, {k.lower(): v or "" for k, v in attrs}), (self.parent, self._open[-1]), (self.lo, len(self.strings)), (self.hi, len(self.strings)), (self.end, i + 1)):
            column.append(value)
        if tag not in _VOID:
            self._open.append(i)
            self._count[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self._count[tag] > 0:
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.strings.append(data)
        self.holder.append(self._open[-1])

    def has(self, i: int, *names: str) -> bool:
        cls = self.attrs[i].get("class", "")
        return any(n in cls for n in names)

    def text(self, i: int) -> str:
        return "".join(self.strings[self.lo[i] : self.hi[i]])

    def short(self, i: int) -> str:
        """The text of an element that should hold a number or a time; too long a one is neither."""
        return self.text(i) if self._chars[self.hi[i]] - self._chars[self.lo[i]] <= _SHORT else ""

    def blank(self, i: int) -> bool:
        return self._inked[self.hi[i]] == self._inked[self.lo[i]]

    def carried(self, first, step) -> list:
        """A value for each element: ``first`` for the page, ``step(value of the parent, element)`` below."""
        out = [first] * len(self.tags)
        for i in range(1, len(self.tags)):
            out[i] = step(out[self.parent[i]], i)
        return out


def tidy(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[​‌‍﻿]", "", unicodedata.normalize("NFC", text))).strip()


def _number(text: str, signed: bool = False) -> int | None:
    bare = re.sub(r"[,\s]|[가-힣]+", "", text)
    if not re.fullmatch(r"[+-]?\d{1,18}", bare, re.ASCII):
        return None
    return int(bare) if signed or int(bare) >= 0 else None


def _digits(text: str) -> int:
    bare = re.sub(r"\D", "", text)
    return int(bare) if 0 < len(bare) <= 18 else 0


def _post(**values) -> dict:
    base = {"post_id": "", "url": "", "title": "", "body": "", "published_at": None, "first_seen_at": None, "views": 0, "recommendations": 0, "comment_count": 0, "deleted": False, "comments": []}
    return base | values


def _comment(**values) -> dict:
    return {"id": None, "parent_id": None, "depth": 0, "body": "", "author": None, "published_at": None, "recommendations": 0, "deleted": False} | values


def simple_list(html: str) -> list[dict]:
    """Stubs of a plain list page: each ``a.post-link`` with the counts and time that follow it."""
    page, out = Page(html), []
    for i, tag in enumerate(page.tags):
        if tag == "a" and page.has(i, "post-link"):
            out.append(_post(post_id=page.attrs[i].get("data-id", ""), url=page.attrs[i].get("href", ""), title=page.text(i).strip()))
        elif out and tag == "span":
            for name, key in _SIMPLE_COUNTS:
                if page.has(i, name):
                    out[-1][key] = _digits(page.short(i))
                    break
        elif out and tag == "time" and page.has(i, "published") and page.attrs[i].get("datetime"):
            out[-1]["published_at"] = page.attrs[i]["datetime"]
    return [p for p in out if p["title"]]


def simple_post(html: str) -> list[dict]:
    """The first ``article.post``; an empty post if there is none. Comments found replace the declared number.

    A string belongs to the innermost comment around it, or else to the post, and to its body if it stands in a ``div.body`` of that comment or post.
    """
    page, p = Page(html), _post()
    article = next((i for i, tag in enumerate(page.tags) if tag == "article" and page.has(i, "post")), None)
    if article is None:
        return [p]
    tags, last = page.tags, page.end[article]
    # of each element: whether a comment is around it, which one it belongs to, and whether it stands in a body
    is_comment = [tag == "div" and page.has(i, "comment") for i, tag in enumerate(tags)]
    number: dict[int, int] = {}

    def step(above: tuple, i: int) -> tuple:
        around, own, body = above
        around = around or is_comment[page.parent[i]]
        if article < i < last and tags[i] == "div":
            if is_comment[i] and not page.has(i, "body"):
                number[i] = len(p["comments"])
                p["comments"].append(_comment())
                return around, number[i], False
            if page.has(i, "body"):
                # as it has always been: a body in what only looks like a comment goes to the latest one
                return around, own if own is not None or not around or not p["comments"] else len(p["comments"]) - 1, True
        return around, own, body

    state = page.carried((False, None, False), step)
    said: dict[int | None, list[str]] = {}
    for k in range(page.lo[article], page.hi[article]):
        _, own, body = state[page.holder[k]]
        if body and (word := page.strings[k].strip()):
            said.setdefault(own, []).append(word)
    for own, parts in said.items():
        (p if own is None else p["comments"][own])["body"] = " ".join(parts)
    latest, heading = -1, None
    for i in range(article + 1, last):
        tag, around = tags[i], state[i][0]
        latest = number.get(i, latest)
        if i in number:
            p["comment_count"] = latest + 1
        elif tag == "span" and page.has(i, "author") and around and latest >= 0:
            p["comments"][latest]["author"] = page.short(i).strip() or None
        elif tag == "h1" and page.has(i, "title"):
            heading = i
        elif tag == "span" and not around:
            for name, key in _SIMPLE_COUNTS:
                if page.has(i, name):
                    p[key] = _digits(page.short(i))
                    break
        elif tag == "time" and page.has(i, "published") and page.attrs[i].get("datetime"):
            p["published_at"] = page.attrs[i]["datetime"]
    p["title"] = page.text(heading).strip() if heading else ""
    return [p]


def board_list(html: str) -> list[dict]:
    """Every link with text; document ids are resolved by columns afterwards. No counts on list pages."""
    page = Page(html)
    return [_post(url=page.attrs[i]["href"], title=t) for i, tag in enumerate(page.tags) if tag == "a" and page.attrs[i].get("href") and (t := tidy(page.text(i)))]


def board_post(html: str) -> list[dict]:
    """A detail page of the board layout. A comment's body is the first body element of its own; comments inside it keep their words to themselves."""
    page, p = Page(html), _post()
    tags, attrs, has, every = page.tags, page.attrs, page.has, range(1, len(page.tags))
    for i in every:
        name = (attrs[i].get("property") or attrs[i].get("name") or "").lower() if tags[i] == "meta" else ""
        if name == "og:title" and not p["title"]:
            p["title"] = tidy(attrs[i].get("content", ""))
        elif name == "og:url" and not p["url"]:
            p["url"] = attrs[i].get("content", "")
    lists = page.carried(0, lambda n, i: n + (tags[page.parent[i]] == "ul"))
    replies = page.carried(False, lambda r, i: r or has(page.parent[i], "reply_list"))
    own = page.carried(0, lambda c, i: i if _is_comment(page, i) else c)  # 0: no comment
    later = len(tags)
    inner = [False] * len(tags)  # whether a body lies within
    for i in reversed(every):
        inner[i] = later < page.end[i]
        if tags[i] in ("div", "section") and has(i, *BODY):
            later = i
    chosen: dict[int, int] = {}  # of a comment, its body
    comments: dict[int, dict] = {}
    for i in every:
        tag, c = tags[i], own[i]
        if c:
            if c not in chosen and tag in ("div", "p", "span") and i != c and has(i, *COMMENT_BODY):
                chosen[c] = i
                depth = max(0, lists[c] - 1) if tags[c] == "li" else int(has(c, "reply") or replies[c])
                comments[c] = _comment(id=_comment_id(attrs[c]), depth=depth)
            continue
        if tag in ("h1", "h2", "div") and has(i, *TITLE) and not p["title"]:
            p["title"] = "" if page.blank(i) else tidy(page.text(i))
        elif tag in ("div", "section", "article") and has(i, *BODY):
            if not p["body"] and not inner[i] and not page.blank(i):
                p["body"] = tidy(page.text(i))
        elif tag in ("span", "div", "em") and has(i, *COUNTS):
            p["comment_count"] = v if (v := _number(page.short(i))) is not None else p["comment_count"]
        elif tag in ("span", "div", "em") and has(i, *VIEWS):
            p["views"] = v if (v := _number(page.short(i))) is not None else p["views"]
        elif tag in ("span", "div", "em") and has(i, *LIKES):
            p["recommendations"] = v if (v := _number(page.short(i), signed=True)) is not None else p["recommendations"]
        elif p["published_at"] is None and (tag == "time" or tag in ("span", "div", "em") and has(i, *DATES)):
            # the attribute, or else the text; what names no zone is no date, and a later element may have one
            p["published_at"] = next((x for x in (attrs[i].get("datetime", "").strip(), tidy(page.short(i))) if _ABSOLUTE.fullmatch(x)), None)
    within = page.carried(False, lambda w, i: i == chosen.get(own[i]) or w and own[i] == own[page.parent[i]])
    said: dict[int, list[str]] = {c: [] for c in comments}
    for text, i in zip(page.strings, page.holder, strict=True):
        if own[i] and within[i]:
            said[own[i]].append(text)
    for c, parts in said.items():
        comments[c]["body"] = tidy("".join(parts))
    p["comments"] = list(comments.values())
    p["comment_count"] = p["comment_count"] or len(comments)
    return [p]


def _is_comment(page: Page, i: int) -> bool:
    tag = page.tags[i]
    return tag == "li" and page.has(i, "fdb_itm") or tag == "div" and (page.has(i, "cmt_item") or page.has(i, "comment") and not page.has(i, *COMMENT_BODY, *COUNTS, "comment_list"))


def _comment_id(attrs: dict[str, str]) -> str | None:
    own = attrs.get("id", "")
    for text in (own.removeprefix("comment_") if own.startswith("comment_") else "", attrs.get("data-comment_srl", "")):
        if digits := re.sub(r"\D", "", text):
            return digits
    m = re.search(r"comment[-_](\d+)", attrs.get("class", ""))
    return m[1] if m else None


_COMMENT_TYPE = pa.struct([("id", pa.string()), ("parent_id", pa.string()), ("depth", pa.int32()), ("body", pa.string()), ("author", pa.string()), ("published_at", pa.string()), ("recommendations", pa.int64()), ("deleted", pa.bool_())])
_POST_FIELDS = [*((n, pa.string()) for n in ("post_id", "url", "title", "body", "published_at", "first_seen_at")), *((n, pa.int64()) for n in ("views", "recommendations", "comment_count")), ("deleted", pa.bool_()), ("comments", pa.list_(_COMMENT_TYPE))]


def _composed(post: dict) -> list[str] | None:
    """Title, body and comment bodies with composed characters; NULL if they are composed already."""
    texts = [post["title"], post["body"], *(c["body"] for c in post["comments"])]
    return None if all(unicodedata.is_normalized("NFC", x) for x in texts) else [unicodedata.normalize("NFC", x) for x in texts]


def _parse(pages: DataFrame, parser: Callable[[str], list[dict]], keep: list[str], compose: bool = False) -> DataFrame:
    """One row per post of each page, with the page's ``keep`` columns, the post's place ``pos`` and ``error`` (NULL, or why the page gave no post).

    ``compose`` adds ``_composed``, so that no further worker is needed for it: a task has one worker, which holds what one slice of pages gives.
    """
    fields = [*_POST_FIELDS, ("error", pa.string()), *([("_composed", pa.list_(pa.string()))] if compose else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", _SLICE):
            at, pos, rows = [], [], []
            for i, page in enumerate(b.column(b.schema.get_field_index("html")).to_pylist()):
                try:
                    found = [p | {"error": None} for p in parser(page)]
                except Exception as e:  # whatever a page does, it does to itself
                    found = [_post(error=f"{type(e).__name__}: {e}"[:200])]
                at += [i] * len(found)
                pos += range(len(found))
                rows += [p | {"_composed": _composed(p)} for p in found] if compose else found
            kept = [b.column(b.schema.get_field_index(c)).take(pa.array(at, pa.int64())) for c in keep]
            made = [pa.array([r[n] for r in rows], t) for n, t in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pos, pa.int64()), *made], names=[*keep, "pos", *(n for n, _ in fields)])

    kept = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, F.col("html").cast("string").alias("html")).mapInArrow(run, f"{kept}pos long, {POST}, error string{', _composed array<string>' if compose else ''}")


def _good(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is null").drop("error")


def page_errors(pages: DataFrame, layout: str = "simple", detail: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pages that cannot be parsed: ``keep`` columns and ``error``."""
    parser = {("simple", False): simple_list, ("simple", True): simple_post, ("board", False): board_list, ("board", True): board_post}[layout, detail]
    return _parse(pages, parser, list(keep)).filter("error is not null").select(*keep, "error")


def links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every link of a page that has text."""
    return _good(_parse(pages, board_list, list(keep)))


def parse_lists(pages: DataFrame, layout: str = "simple", site: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Stubs of list pages (column html). Board links need a document id of six or more digits."""
    if layout == "simple":
        return _good(_parse(pages, simple_list, list(keep)))
    p = links(pages, keep)
    return p.withColumn("post_id", document_id(F.col("url"))).filter("post_id is not null").withColumn("url", canonical_url(F.col("url"), site))


def parse_posts(pages: DataFrame, layout: str = "simple", site: str = "", keep: tuple[str, ...] = (), post_id: str = "post_id", first_seen=None) -> DataFrame:
    """Posts of detail pages. Board pages carry no id: it comes from the column ``post_id``, and pages without one go."""
    if layout == "simple":
        out = _good(_parse(pages, simple_post, list(keep)))
    else:
        named = pages.withColumn("_pid", F.col(post_id).cast("string")).filter("_pid <> ''")
        out = _good(_parse(named, board_post, [*(c for c in keep if c != "post_id"), "_pid"], compose=True)).withColumn("post_id", F.col("_pid")).drop("_pid")
        out = out.withColumns({"url": canonical_url(F.col("url"), site), "published_at": absolute_datetime(F.col("published_at"))})
        title, body = (F.coalesce(F.get("_composed", F.lit(i)), c) for i, c in enumerate(("title", "body")))
        comments = F.coalesce(F.expr("slice(_composed, 3, size(comments))"), F.expr("transform(comments, c -> c.body)"))
        gone = tidy_column(F.concat_ws(" ", title, body)).rlike("(?U)" + DELETED)
        out = out.withColumn("deleted", gone).filter(F.col("deleted") | evidence(F.col("title"), F.col("body"), F.col("comments")))
        out = out.withColumn("content_hash", content_hash(F.col("post_id"), title, body, comments, compose=False)).drop("_composed")
    return out.withColumn("first_seen_at", first_seen) if first_seen is not None else out


def read_pages(spark, path: str, glob: str = "*.html") -> DataFrame:
    """(file, html) of the pages below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))


def read_fixture_posts(spark, path: str) -> DataFrame:
    """Titled posts of the ``post-*.html`` files of a folder, in the order of their names; list pages are skipped."""
    pages = read_pages(spark, path, "post-*.html").filter(~F.contains(F.lower(F.element_at(F.split("file", "/"), -1)), F.lit("list")))
    return parse_posts(pages, "simple", keep=("file",)).filter("title <> ''").orderBy("file")
