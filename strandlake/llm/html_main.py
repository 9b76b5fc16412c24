"""Main text of web pages by the maximum-scoring run of tokens.

A page is a sequence of words and tags. A word scores the chance that words in its surroundings are main text, a tag
costs the more the seldomer it stands inside main text. One linear scan finds the contiguous run with the largest sum.
The element that holds the run's main words is the content region; blocks in it whose surroundings read as something
else (an advert or a form inside the article) are left out.

Chances and costs are counted on labelled pages: pages of the table (a bounded sample) whose own markup names their
article, on top of prior counts for usual names, which a table that uses a name otherwise outweighs. An element's
features are its name, where that says something, and the words of its class, id and role: each whole, and its last part
(``cookie-notice`` is a notice, ``share-price`` no share), unless it tells a state (``has-sidebar``). What an element's
names say holds for what is in it, but names against main text are ignored on an element that holds a headline and most
of the page's words.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages of the table that weights are counted on at most: the first by a hash of their id.
SAMPLE = 1000
#: Words that each prior name counts for.
PRIOR = 200
#: A word in surroundings with a weight under this stands outside main text.
NEGATIVE = -1.5
#: The weight of surroundings that nothing is known about.
NEUTRAL = 1.0
#: What a tag costs that never stands inside main text, and how many such sightings an unknown one counts for, of four.
COST, UNKNOWN = 8.0, 0.3
# HTML element kinds, and usual names of main text and of what is not.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNSEEN = frozenset("template svg math select object canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address hr".split()) | INLINE
TELLING = frozenset("article main nav aside header footer form menu dialog button label fieldset".split())
STATES = frozenset("has with without no not is show hide hidden".split())
MAIN_NAMES = "article main content post entry story".split()
OTHER_NAMES = """ad ads adv advert adverts advertisement advertising aside banner breadcrumb breadcrumbs button byline comment comments
commentlist consent cookie cookies copyright dialog disclaimer disqus fieldset footer form gdpr header label login masthead menu
modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted recommended
related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget""".split()

# A tag ends at the first > outside quoted values; a quote elsewhere is a letter like any other, as in browsers. Nothing
# that has matched is tried again, so a tag is read in time linear in its length.
_VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]++))"""
_ATTRIBUTE = rf"""=?+([^\s/>=]++)(?:\s*+=\s*+{_VALUE}?+)?+"""
_TAG = re.compile(rf"<(/?+)([A-Za-z][^\s/>]*+)((?:[\s/]++|{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)}|=)*+)>")
_NAMED = re.compile(rf"(?:[\s/]++|{_ATTRIBUTE}|=)")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def markup(text: str) -> Iterator[tuple[str, str, str]]:
    """Pieces of a page in order: ("", "", text), (name, "", attributes) of a start tag, (name, "/", "") of an end tag.

    Comments, declarations and the contents of RAW elements are left out. A tag that is still open at the end of the
    page is dropped with what follows it, as browsers do. Each character is looked at a bounded number of times.
    """
    at, n = 0, len(text)
    while at < n:
        start = text.find("<", at)
        if start < 0:
            yield "", "", text[at:]
            return
        if start > at:
            yield "", "", text[at:start]
        ahead = text[start + 1 : start + 3]
        if ahead[:1].isascii() and ahead[:1].isalpha() or ahead[:1] == "/" and ahead[1:].isascii() and ahead[1:].isalpha():
            tag = _TAG.match(text, start)
            if not tag:
                return
            name, at = tag.group(2).lower(), tag.end()
            yield name, tag.group(1), "" if tag.group(1) else tag.group(3)
            if name in RAW and not tag.group(1):
                close = _CLOSERS[name].search(text, at)
                at = close.start() if close else n
        elif text.startswith("<!--", start):
            end = text.find("-->", start + 2)
            at = n if end < 0 else end + 3
        elif ahead[:1] in ("!", "?", "/") and ahead[:1]:
            end = text.find(">", start)
            at = n if end < 0 else end + 1
        else:
            yield "", "", "<"
            at = start + 1


def names(attributes: str) -> list[str]:
    """Features of a start tag's class, id and role: words, and last parts of compounds that tell no state."""
    out = []
    for m in _NAMED.finditer(attributes):
        if m.group(1) and m.group(1).lower() in ("class", "id", "role"):
            for word in html.unescape(m.group(2) or m.group(3) or m.group(4) or "").split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                if parts:
                    out.append("." + "-".join(parts))
                    if len(parts) > 1 and not STATES.intersection(parts):
                        out.append("." + parts[-1])
    return out


class Page:
    """Tokens of a page as (context, tag or "", words), its contexts as (features, parent, name) and its text blocks as
    (context, first token, text). Words come with their context, tags with the one around them."""

    def __init__(self, source: str):
        self.tokens: list[tuple[int, str, int]] = []
        self.contexts: list[tuple[list[str], int, str]] = [([], -1, "")]
        self.blocks: list[tuple[int, int, str]] = []
        self.words, self.headline = [0], [False]  # of each context with all in it
        stack, pieces = [("", 0)], []
        first = where = hidden = 0

        def end_block() -> None:
            if pieces:
                said = " ".join("".join(pieces).split())
                if said:
                    self.blocks.append((where, first, said))
                pieces.clear()

        for name, closing, rest in markup(source):
            if not name:
                if hidden:
                    continue
                said = html.unescape(rest)
                n = len(said.split())
                if n and not any(p.strip() for p in pieces):
                    first, where = len(self.tokens), stack[-1][1]
                pieces.append(said)
                if n:
                    self.tokens.append((stack[-1][1], "", n))
                    self.words[stack[-1][1]] += n
                continue
            if name in RAW:
                continue
            if name in UNSEEN:
                hidden = max(0, hidden + (-1 if closing else 0 if rest.endswith("/") else 1))
                continue
            if hidden:
                continue
            if name not in INLINE:
                end_block()
            elif name == "br":
                pieces.append(" ")
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        self.tokens.append((self.contexts[stack[k][1]][1], "/" + name, 0))
                        del stack[k:]
                        break
                continue
            while len(stack) > 1 and (name in CLOSED_BY.get(stack[-1][0], ()) or stack[-1][0] in INLINE and name in CLOSED_BY["p"] and any(s[0] == "p" for s in stack[-8:])):
                stack.pop()
            self.tokens.append((stack[-1][1], name, 0))
            if name in VOID:
                continue
            own = names(rest) if "=" in rest else []
            if name in TELLING:
                inside = any(self.contexts[s[1]][2] in ("article", "main") for s in stack)
                # An article's own header is part of it.
                own.append(f"{name}@" if inside and name == "header" else name)
            self.contexts.append((own, stack[-1][1], name))
            self.words.append(0)
            self.headline.append(name == "h1")
            stack.append((name, len(self.contexts) - 1))
        end_block()
        for k in range(len(self.contexts) - 1, 0, -1):
            parent = self.contexts[k][1]
            self.words[parent] += self.words[k]
            self.headline[parent] |= self.headline[k]

    def values(self, weights: dict[str, float]) -> list[float]:
        """How much each context reads as main text: what is under NEGATIVE stays so inside; else the best name around."""
        out: list[float] = []
        for k, (own, parent, _) in enumerate(self.contexts):
            up = out[parent] if parent >= 0 else NEUTRAL
            known = [weights[f] for f in own if f in weights]
            low, high = min(known, default=0.0), max(known, default=0.0)
            if up <= NEGATIVE or low <= NEGATIVE and not (self.headline[k] and 2 * self.words[k] > self.words[0]):
                out.append(min(up, low))
            else:
                out.append(max(up, high))
        return out

    def labelled(self, weights: dict[str, float]) -> list[bool]:
        """For each context, whether it is inside an article or main element, with nothing in between that its names
        tell apart."""
        value, out = self.values(weights), []
        for k, (_, parent, name) in enumerate(self.contexts):
            out.append((name in ("article", "main") or parent >= 0 and out[parent]) and value[k] > NEGATIVE)
        return out


def prior() -> tuple[Counter, Counter]:
    """Counts of words under usual names, as if PRIOR words had been seen under each."""
    main = Counter({f"{dot}{n}": PRIOR for n in MAIN_NAMES for dot in ("", ".") if dot or n in TELLING})
    other = Counter({f"{dot}{n}": PRIOR for n in OTHER_NAMES for dot in ("", ".") if dot or n in TELLING})
    return main, other


def log_odds(main: Counter, other: Counter) -> dict[str, float]:
    """Weight of each feature: how much likelier it is around main text, half a count added, at most 4 either way."""
    return {f: max(-4.0, min(4.0, log(main[f] + 0.5) - log(other[f] + 0.5))) for f in main.keys() | other.keys()}


def count(page: Page, weights: dict[str, float], main: Counter, other: Counter) -> None:
    """Adds a labelled page's words under each feature, and its tags, to the counts of main and other text."""
    inside = page.labelled(weights)
    if not any(inside):
        return
    here: Counter[tuple[int, bool]] = Counter()
    for context, tag, n in page.tokens:
        if tag:
            (main if inside[context] else other)["<" + tag] += 1
        else:
            here[context, inside[context]] += n
    for (context, is_main), n in here.items():
        seen, k = set(), context
        while k > 0:
            seen.update(page.contexts[k][0])
            k = page.contexts[k][1]
        for f in seen:
            (main if is_main else other)[f] += n


class Model:
    """Weights of features and costs of tags, from counts."""

    def __init__(self, main: Counter, other: Counter):
        self.weights = {f: w for f, w in log_odds(main, other).items() if f[0] != "<"}
        self.costs = {f[1:]: COST * (other[f] + UNKNOWN) / (main[f] + other[f] + 4) for f in main.keys() | other.keys() if f[0] == "<"}

    def scores(self, page: Page, value: list[float]) -> list[float]:
        """Each token's score: words times the chance that their surroundings are main text, or less a tag's cost."""
        chance = [1 / (1 + exp(-max(-30.0, min(30.0, v)))) for v in value]
        return [-self.costs.get(tag, COST * UNKNOWN / 4) if tag else n * chance[context] for context, tag, n in page.tokens]


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous run with the largest sum, (0, -1) if none is positive; of equal ones the
    first that ends. One pass."""
    best, run, start, span = 0.0, 0.0, 0, (0, -1)
    for i, gain in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += gain
        if run > best:
            best, span = run, (start, i)
    return span


def main_blocks(page: Page, model: Model) -> list[str]:
    """Texts of the content region: the element that holds the best run, without what reads as something else."""
    value = page.values(model.weights)
    first, last = best_run(model.scores(page, value))
    # The elements around all main words of the run, from the outermost.
    shared: list[int] | None = None
    for k in {c for c, tag, _ in page.tokens[first : last + 1] if not tag and value[c] > NEGATIVE}:
        path = []
        while k >= 0:
            path.append(k)
            k = page.contexts[k][1]
        path.reverse()
        shared = path if shared is None else [a for a, b in zip(shared, path, strict=False) if a == b]
    if not shared:
        return []
    name = [n for _, _, n in page.contexts]
    # The container; an article or main element around it is meant as a whole.
    holder = next((k for k in reversed(shared) if name[k] not in TEXT), 0)
    holder = next((k for k in shared if name[k] in ("article", "main")), holder)
    loose = name[holder] in ("", "html", "body")
    within = [False] * len(name)
    for k, (_, parent, _) in enumerate(page.contexts):
        within[k] = k == holder or parent >= 0 and within[parent] and (not loose or name[k] in TEXT)
    return [text for context, at, text in page.blocks if value[context] > NEGATIVE and (within[context] or first <= at <= last)]


def main_text(source: str | None, model: Model) -> str:
    return "\n\n".join(main_blocks(Page(source), model)) if source else ""


def train(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of prior counts and of a bounded sample of ``pages`` (page_id, html) that name their article."""
    main, other = prior()
    known = log_odds(main, other)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main, other = Counter(), Counter()
            for source in batch.column("html"):
                count(Page(source.as_py()), known, main, other)
            found = sorted(main.keys() | other.keys())
            yield pa.RecordBatch.from_pydict({"feature": pa.array(found, pa.string()), "main": pa.array([main[f] for f in found], pa.int64()), "other": pa.array([other[f] for f in found], pa.int64())})

    first = pages.where("page_id is not null and html is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    some = pages.select("page_id", "html").join(F.broadcast(first), "page_id", "left_semi")
    found = some.mapInArrow(counts, "feature string, main long, other long").groupBy("feature").agg(F.sum("main").alias("main"), F.sum("other").alias("other"))
    # Features of at most ``sample`` pages; a name seen on one page says little.
    for r in found.where("main + other >= 20").collect():
        main[r["feature"]] += r["main"]
        other[r["feature"]] += r["other"]
    return Model(main, other)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    pages: page_id long, url string, html string; other columns are ignored. A null or empty html, and a page without
    a positive run, has an empty text. Blocks are joined by two line breaks; blanks inside one are one space. Null ids
    and urls come out as they are, repeated rows each; very long pages are read whole, in time linear in their length.
    Runs of equal sums: the first. An empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = train(rows)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py(), model) for x in batch.column("html")]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(x) for x in found], pa.int64())})

    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
