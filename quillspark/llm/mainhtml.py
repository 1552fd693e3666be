"""Main text of web pages by consensus host paths.

Every page is parsed into blocks of text under containers.  A container is known by its generalised path: the tags
and classes from the root down, digits in classes replaced.  The best-scored path of each page is its vote; the
votes are counted per host in Spark, and every page is then extracted again with the paths that won on its host:
the first of them whose score on the page is a fair share of that of the page's own best, else the latter.

Score of a path: characters of running text and of headings below it, less twice those of links and of other short
pieces; articles and main parts count half as much again.  Menus, headers, footers, comments, scripts and the like are
left out before scoring, by tag and role; of a header inside an article the headings stay.

Class and id names are read word by word.  A name that is made of words for sidebars, notices, adverts and so on, with
words for structure at most, makes its part a suspect, and so does a form; templates wrap whole pages in such parts,
too.  A page takes a suspect for content if an article or main part lies in it, or if there is none elsewhere and it
holds most of the page's text and few links.  A name that has other words besides (``related-work``, ``search-tips``) is a
weaker hint: such a part is content if an article lies in it, or if it is running text with few links.  These are votes as
well: a host's pages decide together which suspect paths are left out, and weak suspects whose text is the same on pages
that differ otherwise are left out with them.  Only parts named for reader comments and nothing else go at once.

Text: character references are decoded, a line break and cell bounds are white space, white space within a block
becomes one space, blocks are trimmed and joined in page order by an empty line.  Nothing else is dropped.

Defined cases: null and empty pages give an empty text; a page without a container counts as one; null URLs and URLs
without ``://`` share the host ''; a part left open ends with its parent or the page, an open script or comment with
the page; repeated pages vote as often as they occur; of equally scored paths the deepest wins; pages may be of any
length and depth, as time and memory grow in proportion; columns of ``pages`` pass through whatever their names, but for one that is called like the result, which
takes its place; an empty table stays empty.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import materialize, numbered
from quillspark.llm.urlfilter import host_of

MIN_SHARE = 0.1  # of a host's votes, for a path to win; so at most ten paths win
BROADCAST_HOSTS = 100_000  # hosts with paths up to MAX_PATH_CHARS are broadcast, more are joined by a shuffle
MAX_BROADCAST_CHARS = 64_000_000
SHORT = 40
FAIR_SHARE = 0.2  # of the score of a page's own best path, for a winning path to be taken
MAIN, CONTENT, CLUTTER, PROSE = range(4)  # what a vote says of a path
REPEATED_ON = 3  # different pages, for a text that stays the same to be told from content

#: What HTML's elements are.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACES = frozenset("br td th wbr img hr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption legend summary pre address option thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What is left out.
LEFT_OUT_TAGS = frozenset("nav footer aside noscript template button select option svg math object canvas audio video dialog menu datalist".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
SUSPECT_TAGS = frozenset(["form", "fieldset"])
SUSPECT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead ad ads adv advert adverts advertisement advertising sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond discussion pagination pager toolbar widget "
    "search skip".split()
)
STRUCTURE_WORDS = frozenset(
    "area bar block body bottom box button buttons card cell center col column container content count cta element entry fixed floating form global grid group head heading "
    "icon icons image inline inner item items js label layout left level line link links list main page panel part post primary reader readers right row secondary section "
    "site slot static sticky tab table text thread title top unit user users view wide wrap wrapper x".split()
)
HEADER_WORDS = frozenset(["header"])
#: Parts that only a whole name can leave out, those names, and words that turn a name into a remark.
WHOLE = frozenset("html body article main".split())
COMMENT_NAMES = frozenset("comment comments reply replies".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
WEAK_WORDS = frozenset(["discussion"])
QUALIFIERS = frozenset("has with without no is".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_DIGITS = re.compile(r"\d+")


_STRONG, _WEAK = 1, 2
_MASK = (1 << 64) - 1


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def path_key(parent: str, name: str) -> str:
    """128 bits that stand for a path, from its parent's and its last tag with classes."""
    return xxhash.xxh3_128_hexdigest(f"{parent}/{name}".encode("utf-8", "replace"))


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if "=" in text else {}


class Page:
    """Blocks of one page: (path number, text, characters inside links, whether it is a heading).

    Paths are numbers, with their parent, depth, last tag, whether they lie in an article, and a digest of the tags and
    classes from the root, which stands for the path on other pages.  Suspects are numbers, too: their path, the suspect
    around them, whether an article is inside, whether they are weak.  What lies below is summed up from the last to the
    first, as parents come before their children, so that work does not grow with depth.
    """

    def __init__(self, source: str | None):
        self.keys: list[str] = [""]
        self.parents, self.depths, self.tags, self.in_article = [-1], [0], [""], [False]
        self.numbers: dict[tuple[int, str], int] = {}
        self.every: list[tuple[int, str, int, bool]] = []
        self.within: list[int] = []  # by block, the innermost suspect around it, or -1
        self.suspects: list[tuple[str, int, bool]] = []
        self.with_article: list[bool] = []
        if source:
            self._read(source)
        self.blocks = self.every
        self.print = sum(hash64(text) for _, text, _, _ in self.every) & _MASK
        self.judged, self.prints = self._judged()

    def _judged(self) -> tuple[dict[str, int], dict[str, int]]:
        """By path of a suspect, what this page says of it, and a digest of its text."""
        n = len(self.suspects)
        plain, linked, running, digest, article = [0] * n, [0] * n, [0] * n, [0] * n, self.with_article
        total, outside = 0, False
        for (path, text, links, heading), i in zip(self.every, self.within, strict=True):
            own = max(len(text) - links, 0)
            total += own
            if i < 0:
                outside = outside or self.in_article[path]
                continue
            plain[i], linked[i], digest[i] = plain[i] + own, linked[i] + links, digest[i] + hash64(text)
            running[i] += own if heading or len(text) >= SHORT else 0
        for i in range(n - 1, -1, -1):
            around = self.suspects[i][1]
            if around >= 0:
                for sums in (plain, linked, running, digest):
                    sums[around] += sums[i]
                article[around] = article[around] or article[i]
        found, prints = {}, {}
        for i, (key, _, weak) in enumerate(self.suspects):
            if article[i]:
                says = CONTENT
            elif weak:
                says = PROSE if 2 * linked[i] < plain[i] and 2 * running[i] >= plain[i] else CLUTTER
            else:
                says = CONTENT if not outside and 2 * plain[i] > total and linked[i] < plain[i] else CLUTTER
            before = found.get(key, CLUTTER)
            found[key] = says if before == CLUTTER else before
            prints[key] = (prints.get(key, 0) + digest[i]) & _MASK
        return found, prints

    def settle(self, content: set[str]) -> None:
        """Leave out the blocks in suspects that are no content."""
        fine: list[bool] = []
        for key, around, _ in self.suspects:
            fine.append(key in content and (around < 0 or fine[around]))
        self.blocks = [b for b, i in zip(self.every, self.within, strict=True) if i < 0 or fine[i]]

    def own_content(self) -> set[str]:
        return {key for key, says in self.judged.items() if says != CLUTTER}

    def _read(self, source: str) -> None:
        # an open element: tag, path number, left out (0 no, 1 but for headings, 2 yes), the innermost suspect around
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, -1)]
        opened: Counter[str] = Counter()
        endless: set[str] = set()  # inline tags that have no end tag any more
        pieces: list[str] = []
        links: list[str] = []
        in_link = False
        at, end = 0, len(source)

        def flush() -> None:
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.every.append((stack[-1][1], text, sum(map(len, links)), stack[-1][0] in HEADINGS))
                    self.within.append(stack[-1][3])
                pieces.clear()
            links.clear()

        while at < end:
            tag_at = source.find("<", at)
            if tag_at < 0:
                tag_at = end
            if tag_at > at:
                self._text(source[at:tag_at], stack[-1], pieces, links, in_link)
            if tag_at == end:
                break
            if source.startswith("<!--", tag_at):
                close = source.find("-->", tag_at + 4)
                at = end if close < 0 else close + 3
                continue
            if source.startswith(("<!", "<?"), tag_at):
                close = source.find(">", tag_at)
                at = end if close < 0 else close + 1
                continue
            found = _TAG.match(source, tag_at) or _LOOSE_TAG.match(source, tag_at)
            if not found:
                self._text("<", stack[-1], pieces, links, in_link)
                at = tag_at + 1
                continue
            at = found.end()
            closing, tag = found[1], found[2].lower()
            if tag in RAW and not closing:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                if not close:
                    break
                at = source.find(">", close.start())
                at = end if at < 0 else at + 1
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = not closing
                if not closing and tag not in endless and stack[-1][2] < 2 and found[3] and (self._left_out(tag, found[3]) or self._suspect(tag, found[3]) == _STRONG):
                    # an inline part that is left out lasts to its own end tag
                    close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    if close:
                        at = close.end()
                    else:
                        endless.add(tag)
                continue
            if tag in SPACES and (tag not in LEAVES or tag in ("td", "th")):
                pieces.append(" ")
                continue
            if tag in VOID:
                continue
            flush()
            if closing:
                while opened[tag]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
                in_link = False
                continue
            if found[3].endswith("/") and tag not in LEAVES:
                continue
            while stack[-1][0] in LEAVES and (tag not in LEAVES or stack[-1][0] not in ("li", "dd", "tbody", "thead", "tfoot") or stack[-1][0] == tag):
                if stack[-1][0] in ("li", "dd") and tag not in LEAVES:
                    break  # lists and parts may stand inside a list item
                opened[stack.pop()[0]] -= 1
            _, path, out, around = stack[-1]
            out = max(out, self._left_out(tag, found[3], path)) if out < 2 else out
            if out == 1 and tag in HEADINGS:
                out = 0
            own = self._path(path, tag, found[3]) if tag not in LEAVES else path
            suspect = self._suspect(tag, found[3]) if out < 2 else 0
            if suspect:
                named = own if own != path else self._path(path, tag, found[3])
                self.suspects.append((self.keys[named], around, suspect == _WEAK))
                self.with_article.append(False)
                around = len(self.suspects) - 1
            if out < 2 and around >= 0 and tag in ("article", "main"):
                self.with_article[around] = True
            stack.append((tag, own, out, around))
            opened[tag] += 1
        flush()

    @staticmethod
    def _text(text: str, top: tuple[str, int, int, int], pieces: list[str], links: list[str], in_link: bool) -> None:
        if top[2]:
            return
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if in_link:
            links.append(text.strip())

    def _left_out(self, tag: str, attributes: str, path: int = 0) -> int:
        if tag in LEFT_OUT_TAGS:
            return 2
        if tag == "header":
            return 1 if self.in_article[path] else 2
        if not attributes or "=" not in attributes:
            return 0
        named = _attributes(attributes)
        if named.get("role", "").lower() in LEFT_OUT_ROLES:
            return 2
        if tag in WHOLE:
            return 2 if COMMENT_NAMES & {n.lower() for n in self._names(named)} else 0
        words, _ = self._words(named)
        if words & COMMENT_WORDS:
            return 2
        found = words & SUSPECT_WORDS
        return 1 if found and found <= HEADER_WORDS and self.in_article[path] else 0

    def _suspect(self, tag: str, attributes: str) -> int:
        if tag in SUSPECT_TAGS:
            return _STRONG
        if tag in WHOLE or not attributes or "=" not in attributes:
            return 0
        named = _attributes(attributes)
        words, weak = self._words(named)
        return _STRONG if words or named.get("role", "").lower() == "form" else _WEAK if weak else 0

    @staticmethod
    def _names(named: dict[str, str]) -> list[str]:
        return [n for k in ("class", "id") if k in named for n in named[k].split()]

    def _words(self, named: dict[str, str]) -> tuple[set[str], bool]:
        """The words of names that are made of suspect words and words for structure, and whether there are names of
        suspect words and others; names with a word that turns them into a remark do not count."""
        words, weak = set(), False
        for name in self._names(named):
            own = {w.lower() for w in _WORD.findall(name)}
            if own & QUALIFIERS or not own & SUSPECT_WORDS:
                continue
            if own <= SUSPECT_WORDS | STRUCTURE_WORDS and not own & WEAK_WORDS:
                words |= own
            else:
                weak = True
        return words, weak

    def _path(self, parent: int, tag: str, attributes: str) -> int:
        classes = sorted({_DIGITS.sub("#", c) for c in _attributes(attributes).get("class", "").split()})
        name = ".".join([tag, *classes])
        key = (parent, name)
        if key not in self.numbers:
            self.numbers[key] = len(self.keys)
            self.keys.append(path_key(self.keys[parent], name))
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.tags.append(tag)
            self.in_article.append(self.in_article[parent] or tag in ("article", "main") or "article" in classes or "main" in classes)
        return self.numbers[key]

    def scores(self) -> dict[int, float]:
        """Score of every path that has text below it."""
        sums, below = [0.0] * len(self.keys), [False] * len(self.keys)
        for path, text, linked, heading in self.blocks:
            plain = max(len(text) - linked, 0)
            good = plain if len(text) >= SHORT or heading else 0
            sums[path] += good - 2.0 * (min(linked, len(text)) + (0 if good or text[-1:] in ".!?:;" else min(plain, SHORT) / 4))
            below[path] = True
        for path in range(len(sums) - 1, 0, -1):
            if below[path]:
                parent = self.parents[path]
                sums[parent] += sums[path]
                below[parent] = True
        lifted = lambda p: 1.5 if sums[p] > 0 and self.tags[p] in ("article", "main") else 1.0
        return {p: lifted(p) * sums[p] for p in range(len(sums)) if below[p]}

    def best(self, scores: dict[int, float] | None = None) -> tuple[str, float] | None:
        """The best path and its score; of equal ones the deepest."""
        scores = self.scores() if scores is None else scores
        if not scores:
            return None
        top = max(scores, key=lambda p: (scores[p], self.depths[p], self.keys[p]))
        return self.keys[top], scores[top]

    def text_under(self, key: str) -> str:
        inside = [False] * len(self.keys)
        for i, p in enumerate(self.keys):
            inside[i] = p == key or (self.parents[i] >= 0 and inside[self.parents[i]])
        return "\n\n".join(text for at, text, *_ in self.blocks if inside[at])


def votes(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, says, print, rest, votes, score): on how many pages of the host this is the best path, or a suspect
    that is content, clutter, or running text; of the last the digests of that text and of the rest of the page."""
    read = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kinds = {"host": pa.string(), "path": pa.string(), "says": pa.int32(), "print": pa.int64(), "rest": pa.int64(), "score": pa.float64()}

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows = [(h, *vote) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for vote in _page_votes(t)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    cast = read.mapInArrow(batches, "host string, path string, says int, print long, rest long, score double")
    return cast.groupBy("host", "path", "says", "print", "rest").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.round("score")).alias("score"))


def _page_votes(source: str | None) -> Iterator[tuple[str, int, int, int, float]]:
    page = Page(source)
    for path, says in page.judged.items():
        own = page.prints[path] if says == PROSE else 0
        rest = (page.print - own) & _MASK if says == PROSE else 0
        yield path, says, own >> 1, rest >> 1, 0.0
    page.settle(page.own_content())
    best = page.best()
    if best:
        yield best[0], MAIN, 0, 0, best[1]


def winning_paths(cast: DataFrame) -> DataFrame:
    """(host, paths, content): the paths with at least ``MIN_SHARE`` of the host's votes, most votes first, and the
    suspects that most pages take for content, but for those whose text is much the same on pages that are not."""
    main = cast.where(F.col("says") == MAIN)
    total = main.groupBy("host").agg(F.sum("votes").alias("total"))
    won = main.join(total, "host").where(F.col("votes") >= F.col("total") * MIN_SHARE)
    ordered = F.sort_array(F.collect_list(F.struct("votes", "score", "path")), asc=False)
    won = won.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))
    prose = F.col("says") == PROSE
    sided = F.sum(F.when(F.col("says") == CLUTTER, -F.col("votes")).otherwise(F.col("votes")))
    told = F.count_distinct(F.when(prose, F.col("print"))).alias("texts"), F.count_distinct(F.when(prose, F.col("rest"))).alias("pages")
    fine = cast.where(F.col("says") != MAIN).groupBy("host", "path").agg(sided.alias("more"), *told)
    fine = fine.where((F.col("more") > 0) & ~((F.col("pages") >= REPEATED_ON) & (2 * F.col("texts") <= F.col("pages"))))
    fine = fine.groupBy(F.col("host").alias("fine_host")).agg(F.array_sort(F.collect_list("path")).alias("content"))
    joined = won.join(fine, F.col("host") == F.col("fine_host"), "left")
    return joined.select("host", "paths", F.coalesce("content", F.array().cast("array<string>")).alias("content"))


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", text_col: str = "main_text", keep_html: bool = True) -> DataFrame:
    """``pages`` with the main text of each; ``keep_html=False`` leaves the source out."""
    winners = materialize(winning_paths(votes(pages, url_col=url_col, html_col=html_col)), "paths")
    chars = F.aggregate(F.concat("paths", "content"), F.lit(0), lambda a, p: a + F.length(p))
    bound = winners.agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars")).first()
    if bound.n <= BROADCAST_HOSTS and (bound.chars or 0) <= MAX_BROADCAST_CHARS:
        winners = F.broadcast(winners)
    read, names, kept = numbered(pages, text_col)
    url, page = (names[pages.columns.index(c)] for c in (url_col, html_col))
    read = read.join(winners, host_of(F.col(url)) == F.col("host"), "left").drop("host")
    kept = [(n, c) for n, c in kept if keep_html or n != page]

    def again(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows = zip(*(b.column(n).to_pylist() for n in (page, "paths", "content")), strict=True)
            texts = pa.array([main_text(t, paths or (), content) for t, paths, content in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in kept), texts], names=[*(n for n, _ in kept), "text"])

    fields = [T.StructField(n, read.schema[n].dataType) for n, _ in kept]
    out = read.mapInArrow(again, T.StructType([*fields, T.StructField("text", T.StringType())]))
    return out.toDF(*[c for _, c in kept], text_col)


def main_text(source: str | None, paths: list[str] | tuple[str, ...], content: list[str] | None = None) -> str:
    """The text of a page by a host's winning paths and the suspects that are content there; without a host's, by the
    page's own."""
    page = Page(source)
    page.settle(page.own_content() if content is None else set(content))
    scores = page.scores()
    own = page.best(scores)
    if not own:
        return ""
    known = {page.keys[i]: score for i, score in scores.items()}
    for path in paths:
        if path in known and (known[path] >= FAIR_SHARE * own[1] or path == own[0]):
            return page.text_under(path)
    return page.text_under(own[0])
