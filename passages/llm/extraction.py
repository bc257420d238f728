"""Main text of web pages: templates of hosts by equivalence classes of tokens, and their slots."""

import hashlib
import html as html_module
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passages.llm.shared import saved

# Elements of HTML by what they do to text.
RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
STRUCTURE = frozenset(
    "html head body main article section div header footer nav aside form table tbody ul ol dl"
    " figure details dialog fieldset center".split()
)
BLOCKS = STRUCTURE | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tfoot caption blockquote pre address hr"
    " figcaption summary legend option hgroup".split()
)
# Parts of a page that are not its article, wherever they stand, by element, role and name.
ASIDE = frozenset("head nav aside footer form button dialog menu fieldset".split())
ASIDE_ROLES = frozenset(
    "navigation complementary contentinfo search form dialog alert alertdialog menu menubar".split()
)
# A name that says what the rest of the page has, as has-sidebar, is no part's own name.
_NAME = r"(?:^|[^a-z])(?<!\bhas-)(?<!\bno-)(?<!\bwith-)(?<!\bwithout-)"
ASIDE_NAMES = re.compile(
    _NAME + r"(?:ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|nav|navbar|navigation|menu|sidebar|side|"
    r"footer|breadcrumbs?|comments?|commentlist|respond|repl(?:y|ies)|disqus|cookies?|consent|gdpr|"
    r"notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"share|sharing|social|related|recommend[a-z]*|widget|toolbar|pagination|pager|skip)(?:[^a-z]|$)"
)
# Parts that are not the article unless they stand inside it.
OUTER = frozenset(["header"])
OUTER_ROLES = frozenset(["banner"])
OUTER_NAMES = re.compile(_NAME + r"(?:header|masthead|banner|topbar)(?:[^a-z]|$)")
MAIN_NAMES = re.compile(
    r"(?:^|[^a-z])(?:article|content|main|post|entry|story|body-?text)(?:[^a-z]|$)"
)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")

# Starts of blocks that end an open block without an end tag; any start ends those not listed.
ITEMS, CELLS = frozenset(["li"]), frozenset("td th tr thead tbody tfoot".split())
ENDED_BY = {
    "li": ITEMS, "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": CELLS, "th": CELLS,
    "tr": CELLS - {"td", "th"}, "thead": CELLS - {"td", "th", "tr"}, "tfoot": CELLS - {"td", "th", "tr"},
    "caption": CELLS, "blockquote": frozenset(), "address": frozenset(), "figcaption": frozenset(),
    "hgroup": frozenset(),
}

# Different pages of a host that a token must be on, as a part of them and at least, to be template.
SUPPORT, LEAST_PAGES = 0.5, 3
# Tokens that a class must hold: an element has two, its start and its end.
CLASS_SIZE = 3
# Part of the text in a host's slots that the article's element must hold.
NEARLY_ALL = 0.9
# Templates go to every task up to this size, which is measured.
BROADCAST_BYTES = 64 << 20


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """``kind, name, rest``: text, start and end of elements; raw elements have no text."""
    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        if found is None:
            yield "text", "", page[at:]
            return
        if found.start() > at:
            yield "text", "", page[at : found.start()]
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name = name.lower()
        if found[1] or found[4]:
            yield "end", name, ""
            continue
        attributes = found[3] if found[2] else found[6]
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        yield "start", name, attributes


def named(name: str, attributes: str) -> tuple[str, str, str]:
    """Role, class and id in lower case, and the element as a token of the template."""
    known = {}
    if attributes.strip():
        known = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
    names = f"{known.get('class', '')} {known.get('id', '')}".strip()
    first = names.split()[0] if names else ""
    return known.get("role", ""), names, f"{name}.{first}" if first else name


def is_aside(name: str, role: str, names: str, inside: bool) -> bool:
    if name in ("html", "body", "article", "main"):
        return False
    if name in ASIDE or role in ASIDE_ROLES or (names and ASIDE_NAMES.search(names)):
        return True
    return not inside and bool(
        name in OUTER or role in OUTER_ROLES or (names and OUTER_NAMES.search(names))
    )


class Walk:
    """The path of structural elements that are open while a page is read."""

    def __init__(self):
        self.names: list[str] = []
        self.paths: list[str] = [""]

    def start(self, name: str, token: str) -> str:
        path = f"{self.paths[-1]}/{token}"
        if name in STRUCTURE:
            self.names.append(name)
            self.paths.append(path)
        return path

    def end(self, name: str) -> int:
        """Close the nearest such element; how many are open then. Others stay as they are."""
        if name in STRUCTURE and name in self.names:
            while self.names.pop() != name:
                self.paths.pop()
            self.paths.pop()
        return len(self.names)


class Template:
    """What is known of a host's template: anchors, tokens that are once on a page, and the texts
    of classes that repeat. An anchor of level n was told apart by the anchors of lower levels."""

    def __init__(self, anchors: list[dict] = (), texts: list[str] = (), rounds: int = 0):
        self.levels: list[dict[str, tuple[int, int]]] = [{} for _ in range(rounds)]
        for a in anchors:
            self.levels[a["level"]][a["role"]] = (a["class"], a["rank"])
        self.texts = frozenset(texts)
        self.has_texts = bool(self.texts) or any(" #" in role for level in self.levels for role in level)


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Roles:
    """The roles of a page's tokens: their path and, where that is not yet an anchor, the slot of
    the template they are in, which the last anchor before them tells."""

    def __init__(self, template: Template):
        self.levels = template.levels
        self.last = [""] * len(self.levels)
        self.ranks: dict[int, int] = {}

    def of(self, path: str) -> tuple[str, int | None, bool]:
        """Role, level if it is an anchor, and whether it is out of the order of its class."""
        role = path
        for level, anchors in enumerate(self.levels):
            if role in anchors:
                group, rank = anchors[role]
                moved = rank < self.ranks.get(group, -1)
                self.ranks[group] = max(rank, self.ranks.get(group, -1))
                self.passed(role, level)
                return role, level, moved
            role = f"{path} @{self.last[level]}"
        return role, None, False

    def passed(self, role: str, level: int) -> None:
        self.last[level:] = [digest(role)] * (len(self.last) - level)


def tokens(page: str, template: Template | None = None, runs: set[int] | None = None) -> dict[str, list]:
    """Tokens of a page by role: occurrences, place of the first, characters of slots below, if it
    is aside, such characters in no deeper structure, if it is out of order, and a text's element.

    A token is an element or the whole text of a block. ``runs`` is given the numbers of
    the texts that are of the template; a text's number is that of the block tags before it.
    """
    template = template or Template()
    roles, walk, found = Roles(template), Walk(), {}
    opened: list[tuple[str, int | None]] = [("", None)]
    leaf_path, leaf = "", ""
    aside: int | None = None
    link = run = size = 0
    pieces: list[str] = []

    def add(role: str, moved: bool, parent: str | None) -> list:
        entry = found.setdefault(role, [0, len(found), 0, aside is not None, 0, moved, parent])
        entry[0] += 1
        entry[5] |= moved
        return entry

    def flush() -> None:
        nonlocal size
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            role, level, moved = roles.of(f"{leaf_path} #{digest(text)}")
            add(role, moved, leaf)
            if level is not None or role in template.texts:
                if runs is not None:
                    runs.add(run)
            else:
                for above, _ in opened[1:]:
                    found[above][2] += size
                if len(opened) > 1:
                    found[opened[-1][0]][4] += size
        size = 0

    for kind, name, rest in events(page):
        if kind == "text":
            pieces.append(rest)
            if aside is None and not link:
                size += len(rest.strip())
            continue
        if name in BLOCKS:
            flush()
            run += 1
        if kind == "start":
            role_name, names, token = named(name, rest)
            path = walk.start(name, token)
            if name == "a":
                link = 1
            elif name == "br":
                pieces.append(" ")
            if aside is None and is_aside(name, role_name, names, False) and name in STRUCTURE:
                aside = len(walk.names)
            role, level, moved = roles.of(path)
            add(role, moved, None)
            if name in STRUCTURE:
                opened.append((role, level))
            if name in BLOCKS and name not in VOID:
                leaf_path, leaf = path, role
        else:
            depth = walk.end(name)
            if name == "a":
                link = 0
            if aside is not None and depth < aside:
                aside = None
            while len(opened) > depth + 1:
                role, level = opened.pop()
                if level is not None:
                    roles.passed(f"{role} /", level)
            if name in BLOCKS:
                leaf_path, leaf = walk.paths[-1], opened[-1][0]
    flush()
    return found


def template_runs(page: str, template: Template) -> set[int]:
    """The numbers of the texts of a page that are of the template (see ``tokens``)."""
    runs: set[int] = set()
    if template.has_texts:
        tokens(page, template, runs)
    return runs


def main_text(page: str, container: str | None, template: Template | None = None) -> str:
    """The blocks of a page inside the elements at a path, without asides, one per line.

    Of ``template`` the texts are left out, so that what is left are the slots' values.

    Without a path, or where a page has none of its elements, the outermost ``article`` or
    ``main`` counts, else an element named like one, else the whole page.
    """
    attempts = [(lambda n, p, t: p == container, not re.search(r"/(html|body)[^/]*$", container))] if container else []
    attempts += [
        (lambda n, p, t: n in ("article", "main"), True),
        (lambda n, p, t: bool(t and MAIN_NAMES.search(t)), True),
        (lambda n, p, t: n in ("html", "body"), False),
        (None, False),
    ]
    fixed = template_runs(page, template) if template else set()
    for is_main, narrow in attempts:
        found, text = _blocks(page, is_main, narrow, fixed)
        if found and (text or is_main is None):
            return text
    return ""


def _blocks(page: str, is_main, narrow: bool, fixed: set[int]) -> tuple[bool, str]:
    """Whether there is such an element, and its blocks but for the numbers in ``fixed``;
    ``narrow``: it is less than the page."""
    walk = Walk()
    aside: int | None = None
    main: int | None = 0 if is_main is None else None
    found = is_main is None
    blocks: list[str] = []
    pieces: list[str] = []
    run = 0

    def flush() -> None:
        if pieces:
            if run in fixed:
                pieces.clear()
                return
            text = " ".join(html_module.unescape("".join(pieces)).split())
            if text:
                blocks.append(text)
            pieces.clear()

    for kind, name, rest in events(page):
        if kind == "text":
            if main is not None and aside is None:
                pieces.append(rest)
            continue
        if name in BLOCKS:
            flush()
            run += 1
        if kind == "start":
            inner = walk.names[-1] if walk.names else ""
            if aside == len(walk.names) and inner not in STRUCTURE and name in ENDED_BY.get(inner, BLOCKS):
                walk.names.pop()
                walk.paths.pop()
                aside = None
            role, names, token = named(name, rest)
            path = walk.start(name, token)
            if name in STRUCTURE:
                if aside is None and is_aside(name, role, names, narrow and main is not None):
                    aside = len(walk.names)
                elif main is None and aside is None and is_main(name, path, names):
                    main, found = len(walk.names), True
            elif aside is None and name not in VOID and names and ASIDE_NAMES.search(names) and name in BLOCKS:
                # A block such as <p class="ad">, up to its end tag, a block that ends it or its parent's end.
                walk.names.append(name)
                walk.paths.append(path)
                aside = len(walk.names)
                continue
            if name == "br" and main is not None and aside is None:
                pieces.append(" ")
        else:
            if aside is not None and walk.names and walk.names[-1] == name and name not in STRUCTURE:
                walk.names.pop()
                walk.paths.pop()
            depth = walk.end(name)
            if aside is not None and depth < aside:
                aside = None
            if main is not None and is_main is not None and depth < main:
                flush()
                main = None
    flush()
    return found, "\n".join(blocks)


def host_of(url: Column) -> Column:
    """The host of an address, in lower case without port; null addresses share an empty one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def small(df: DataFrame, size: str) -> DataFrame:
    """``df``, marked to be broadcast by a join if the sum of ``size`` is small enough."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(size))).first()[0] or 0) <= BROADCAST_BYTES else df


_TEMPLATE = "anchors array<struct<role: string, level: int, class: bigint, rank: int>>"
_ROW = "64 + length(host)"
_SIZE = f"{_ROW} + aggregate(anchors, 0L, (total, a) -> total + length(a.role) + 32)"


def _known(batch: pa.RecordBatch) -> Iterator[Template]:
    """The template of each row's host, built once per batch."""
    made: dict[str, Template] = {}
    hosts, columns = batch["host"].to_pylist(), [batch[c] for c in ("anchors", "texts", "rounds")]
    for row, host in enumerate(hosts):
        if host not in made:
            anchors, texts, rounds = (c[row].as_py() for c in columns)
            made[host] = Template(anchors or [], texts or [], rounds or 0)
        yield made[host]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per token of a page."""
    for batch in batches:
        rows = [
            (row, role, *entry)
            for row, (page, template) in enumerate(zip(batch["html"].to_pylist(), _known(batch), strict=True))
            for role, entry in tokens(page, template).items()
        ]
        at, role, n, place, chars, aside, own, moved, parent = zip(*rows, strict=True) if rows else [[]] * 9
        at = pa.array(at, pa.int64())
        numbers = {"n": n, "place": place, "chars": chars, "own": own}
        yield pa.RecordBatch.from_pydict(
            {c: batch[c].take(at) for c in ("host", "key", "weight")}
            | {c: pa.array(values, pa.string()) for c, values in (("role", role), ("parent", parent))}
            | {c: pa.array(values, pa.int64()) for c, values in numbers.items()}
            | {c: pa.array(values, pa.bool_()) for c, values in (("aside", aside), ("moved", moved))}
        )


_COUNTED = (
    "host string, key long, weight double, role string, parent string,"
    " n long, place long, chars long, own long, aside boolean, moved boolean"
)


def _frequent(pages: DataFrame, known: DataFrame) -> DataFrame:
    """The tokens of each host that are on enough of its pages, in classes of equal occurrence
    vectors: ``one`` and ``two``, sums of hashes of page and number, stand for the vector, so no
    task sees all pages of a host."""
    part = lambda seed: F.sum(F.pmod(F.xxhash64("key", "n", F.lit(seed)), F.lit(1 << 32)))
    counted = pages.join(small(known, _SIZE), "host").select(
        "host", "key", "weight", "html", "anchors", "texts", "rounds"
    ).mapInArrow(_count, _COUNTED)
    by_role = counted.groupBy("host", "role", "parent").agg(
        part(1).alias("one"),
        part(2).alias("two"),
        F.round(F.sum("weight")).alias("pages"),
        F.max("n").alias("most"),
        F.avg("place").alias("place"),
        F.sum("chars").alias("chars"),
        F.sum("own").alias("own"),
        F.max("aside").alias("aside"),
        F.max("moved").alias("moved"),
    )
    enough = (F.col("pages") >= F.col("all") * SUPPORT) & (F.col("pages") >= LEAST_PAGES)
    hosts = small(known.select("host", "all"), _ROW)
    return saved(by_role.join(hosts, "host").where(enough))


def _classes(frequent: DataFrame) -> DataFrame:
    """The tokens of large and valid classes. A text nests only in an element of its own class: one
    that is in some of the elements of a role is a value in a slot of theirs."""
    element = frequent.select("host", "one", "two", F.col("role").alias("parent"))
    texts = frequent.where("parent is not null").join(element, ["host", "one", "two", "parent"], "left_semi")
    valid = frequent.where("parent is null").unionByName(texts.select(*frequent.columns))
    weight = F.when(F.col("parent").isNull(), 2).otherwise(1)
    size = F.sum(weight).over(W.partitionBy("host", "one", "two"))
    return valid.withColumn("size", size).where(F.col("size") >= CLASS_SIZE)


def _containers(frequent: DataFrame, classes: DataFrame) -> DataFrame:
    """``host, container``: the path of the element that holds the article's slots.

    Of the elements once on a page that hold nearly all of the slots, those called an article
    come before those named like one, those before others; then the deepest, or the
    nearest around it, where that has paragraphs of its own beside it.
    """
    total = frequent.groupBy("host").agg(F.max("chars").alias("total"))
    path = F.split("role", " ")[0]
    leaf = F.element_at(F.split(path, "/"), -1)
    kind = (
        F.when(leaf.rlike(r"^(article|main)(\.|$)"), 2)
        .when(F.regexp_replace(leaf, r"^[a-z0-9]+", "").rlike(MAIN_NAMES.pattern), 1)
        .otherwise(0)
    )
    depth = F.size(F.split(path, "/"))
    holding = (
        classes.where("parent is null AND most = 1 AND NOT aside AND chars > 0")
        .join(total, "host")
        .where(F.col("chars") >= F.col("total") * NEARLY_ALL)
        .select("host", path.alias("path"), kind.alias("kind"), depth.alias("depth"), "chars", "own")
    )
    upward = W.partitionBy("host").orderBy(F.desc("kind"), F.desc("depth"), "path")
    best = holding.withColumn("nth", F.row_number().over(upward)).where("nth = 1").drop("nth")
    around = holding.select("host", F.struct("depth", F.col("path").alias("wider")).alias("outer"), "own")
    climbed = (
        best.where("kind = 0")
        .select("host", "path", "depth")
        .join(around.where("own > 0"), "host")
        .where(F.expr("outer.depth < depth AND startswith(path, concat(outer.wider, '/'))"))
        .groupBy("host")
        .agg(F.min("outer").alias("outer"))
    )
    return best.join(climbed, "host", "left").select(
        "host", F.coalesce("outer.wider", "path").alias("container")
    )


def templates(pages: DataFrame) -> DataFrame:
    """``host, container, anchors, texts, rounds``: the template of each host that has one.

    ``pages(host, key, html)``; ``key`` tells different pages apart, and copies of a page count
    as one. Tokens are elements, by their path, and the whole texts of blocks. Tokens with equal
    occurrence vectors, a number per page, form a class, which is of the template if it is

    - large and frequent,
    - ordered: its tokens, once on a page, come in the same order on all pages; a token that
      does not is given up,
    - nested: a text is in an element of its class (see ``_classes``).

    Classes once on a page are the anchors, and what lies between two of them is a slot. The
    next round tells tokens of one path apart by the slot they are in, so that some of
    those that repeat on a page become anchors of classes nested in that slot. That goes on for
    the hosts whose template still changes; each round reads their pages once more. Classes
    that still repeat then are nested as lists: their texts, alike in all their elements, are of
    the template too, the others are the list's values.
    """
    seen = saved(pages.groupBy("host", "key").agg(F.count("*").alias("copies")))
    copies = seen.where("copies > 1")
    weight = (1 / F.coalesce("copies", F.lit(1))).alias("weight")
    weighed = pages.join(small(copies, _ROW), ["host", "key"], "left")
    weighed = weighed.select("host", "key", weight, "html")
    hosts = seen.groupBy("host").agg(F.count("*").alias("all")).where(F.col("all") >= LEAST_PAGES)
    nothing = F.lit(None).cast("array<string>")
    known = saved(
        hosts.select("host", "all", F.lit(0).alias("rounds"), nothing.alias("texts"), nothing.alias("given_up"),
                     F.from_json(F.lit("[]"), _TEMPLATE.split(" ", 1)[1]).alias("anchors"))
    )
    done = None
    for level in itertools.count(1):
        frequent = _frequent(weighed, known)
        classes = _classes(frequent)
        old = known.select("host", F.explode("anchors").alias("a")).select("host", "a.role", "a.level")
        refused = known.select("host", F.explode("given_up").alias("role"))
        refused = refused.unionByName(frequent.where("moved").select("host", "role")).distinct()
        order = W.partitionBy("host", "one", "two").orderBy("place", "role")
        anchors = (
            classes.where("most = 1")
            .join(refused, ["host", "role"], "left_anti")
            .withColumn("rank", F.row_number().over(order).cast("int"))
            .join(old, ["host", "role"], "left")
            .withColumn("level", F.coalesce("level", F.lit(level - 1)))
            .withColumn("class", F.xxhash64("one", "two"))
            .groupBy("host")
            .agg(F.collect_list(F.struct("role", "level", "class", "rank")).alias("now"))
        )
        refused = refused.groupBy("host").agg(F.collect_list("role").alias("refused"))
        found = known.join(anchors, "host", "left").join(refused, "host", "left")
        found = saved(found.withColumns({c: F.coalesce(c, F.array()) for c in ("now", "refused")}))
        more = (F.size("now") > F.size("anchors")) | (F.size("refused") > F.size(F.coalesce("given_up", nothing, F.array())))
        ready = found.where(~more).select("host", "anchors", "rounds")
        texts = classes.where("parent is not null AND most > 1").groupBy("host")
        ready = ready.join(texts.agg(F.collect_list("role").alias("texts")), "host", "left")
        ready = ready.join(_containers(frequent, classes), "host", "left")
        done = ready if done is None else done.unionByName(ready)
        growing = found.where(more)
        if growing.isEmpty():
            return done
        known = saved(
            growing.select("host", "all", F.lit(level).alias("rounds"), "texts",
                           F.col("refused").alias("given_up"), F.col("now").alias("anchors"))
        )


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id, url, text, container`` of every row of ``pages``.

    Templates are deduced per host (see ``templates``) and each page yields the values of
    the slots inside its article's element: without texts of the template, menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and comments, character references decoded, white space inside
    a block as one blank, blocks joined by a line end. Hosts with few different pages have no
    template; their pages, and pages that differ from it, are read by what their
    elements are called.

    Only counts of tokens are shuffled, added up per task first; the pages are read once
    a round of ``templates`` and once here, and meet one row per host, which goes to every task
    while all are within ``BROADCAST_BYTES``. Null and empty pages give an empty text, pages
    without an address count as one host. A page repeated gives its text again. An
    empty table gives an empty result; other columns are left out.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        host_of(F.col(url_col)).alias("host"),
    )
    keyed = rows.select("host", F.xxhash64("html").alias("key"), "html")
    known = saved(templates(keyed.where("html is not null")))
    id_type = rows.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(page or "", container, template)
                for page, container, template in zip(
                    batch["html"].to_pylist(), batch["container"].to_pylist(), _known(batch), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].cast(arrow_id), batch["url"], pa.array(texts, pa.string()), batch["container"]],
                names=["id", "url", "text", "container"],
            )

    return (
        rows.join(small(known, _SIZE), "host", "left")
        .select("id", "url", "html", "container", "host", "anchors", "texts", "rounds")
        .mapInArrow(read, f"id {id_type.simpleString()}, url string, text string, container string")
    )
