"""The lines around the main body of a page are found, so that only the main body comes out.

Composite text density over a tree of nodes. The pages here are text, one block per line, so
the tree is induced: the page, its stretches, their lines, and the segments of a line between
signs or wide gaps; a node's characters are those of its lines, its tags the segments. Link
characters are those of lines that are no content of this page: lines of menus, paths and
pointers by their form, and lines that come again, the site's own name left out, on many pages
of several sites or on many pages of their own; a list of what notices and prompts say in four
languages adds to these. A stretch is a run of lines that are all link or all not.

Of every node the composite density is characters by tags, adjusted by the shares of link
characters and link tags in the node and in the page. The densities of a node's children are
summed, and the stretch with the greatest sum is the body. The threshold is the least density
on the way from it up to the page: every stretch that reaches it belongs to the main body (so
does text beyond a sidebar), the others, of links and of scraps, go. Inside, lines that do not
speak (subheadings, labels) stay before lines that do. The headline is the line that repeats the
page's title, or else the nearest short line above.

Pages with markup are the parser's work (``operators.pages``); their readable text comes here.

The lines' digests are kept once for counts and marks; the pages meet the numbers of their
repeated lines in one join.

Defined results: null and blank texts have no lines; a page without any body-like line keeps
its lines that are no link text (an error message or a notice in place of the content is the
body, however often it is repeated); empty lines are neither body nor boilerplate and come out
of neither; a repeated row gives each line once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, narrow

CLOSERS, STOPS = "\"'”»)] ", ".!?。！？"
DECORATION = re.compile(r"^[»›>\s]+|(?:\s*\.\.\.|\s*…)$")
SIGN = re.compile(r" [|/·»›>] ")
SIGNS = re.compile(r"[|/·»›>]")
GAPS = re.compile(r"\s{2,}")
#: "Role - Company, Town": a pointer to another page.
RELATED = re.compile(r"^[^.!?]{3,60} [-–] [^.!?,]{3,60}, [^.!?,]{3,40}$")
ITEM = re.compile(r"^(?:[-•*–]\s+\S|\d+[.)]\s+\S)")
LABEL = re.compile(r"^[^\W\d_][\w'-]*(?: [\w'-]+)?\s?: \S")
WORDS = re.compile(r"[^\W\d_]+")
#: What menus, notices, prompts and footers say, in the corpus's four languages.
PROMPTS = r"""
    ^(?:©|\(c\)\s|copyright\b) | \ball\ rights\ (?:kept|reserved)\b\.?$ | \bderechos\ (?:quedan\ )?reservados | \brechte\ vorbehalten | \bdroits\ r[ée]serv[ée]s
    | ^(?:skip\ to|jump\ to|zum\ inhalt|aller\ au\ contenu|saltar\ al|ir\ al\ contenido|toggle\ |open\ menu|(?:main|site)\ (?:menu|navigation)|menu$|men[uú]\b.{0,12}$)
    | ^(?:we|this\ site|our\ site|.{2,60}\ and\ \d+\ partners)\ (?:uses?|sets?|stores?|keeps?)\ (?:cookies|small\ files) | ^before\ you\ go\ on: | ^your\ choices\ about\ tracking
    | ^you\ can\ withdraw\ consent | ^by\ (?:staying|continuing|browsing|using)\b.{0,40}\ agree | ^read\ more\ in\ our\ notice | ^(?:ok|okay),?\ got\ it | ^manage\ (?:cookies|consent)
    | ^(?:accept|reject|allow|deny|settings|only\ necessary|cookie\ settings)(?:\ (?:all|only|necessary|cookies))*\b(?:\s*[|/·]\s*\w[\w ]*)*$ | aceptas?\ (?:el\ uso\ de\ )?(?:las\ )?cookies | \bcookies?\ (?:zu|ein)\b.{0,40}$
    | ^(?:wir|diese\ seite|nous|ce\ site|usamos|utilizamos|este\ sitio)\b.{0,60}\bcookies\b | \bstimmen\b.{0,60}\bzu\b | \b(?:d[ée]pose|usa|utilise|verwendet)\ (?:des\ )?cookies\b | ^cookies\ help | \bacceptez\ nos\b | en\ (?:continuant|restant)\b.{0,60}\bacceptez
    | ^(?:last\ )?(?:updated|modified|changed|published|posted)(?:\ on|\ at|:)?\ [\w ,]{0,12}\d | ^mis\ [àa]\ jour | ^zuletzt\ ge[äa]ndert | ge[äa]ndert\ am\ \d | ^(?:actualizado|modificado|publicado)\b.{0,6}\ \d | \bel\ \d+\.\d+\.\d+$
    | ^\d+\s+min(?:utes?|uten|utos)?\s+(?:read|lesezeit|de\ lect\w+)\b | ^reading\ time | ^lesezeit | ^temps\ de\ lecture | ^tiempo\ de\ lectura
    | ^(?:filed|posted)\ under | ^tags?: | ^categor(?:y|ies): | ^by\ (?:the\ )?[^.]{2,60}(?:desk|staff|team|newsroom|redaktion)$ | ^(?:posted|written|published|reported)\ by\ | ^(?:by|von|par|por)\ (?:[A-ZÀ-Ý][\w'’-]+\ ?){2,4}(?:,\ [\w ]{2,60})?$ | ^from\ our\ correspondent
    | ^share\ (?:this|on|via|by)\b | ^(?:liked?|enjoyed)\ (?:it|this)\? | ^advertise\ on\b | ^pass\ it\ on | ^forward\ to\ a\ | ^send\ (?:this\ )?to\ a\ (?:friend|colleague) | ^tell\ a\ (?:friend|colleague) | ^partage[rz]\ | ^compart[ae]\w*\ (?:esta|este)\ | ^teilen\b | \bteilen:\ | ^diese\ seite\ .{0,30}(?:teilen|empfehlen) | ^(?:print|save|copy\ link)(?:\s*[|/·]\s*(?:print|save|share|copy\ link|mail))+$
    | ^save\ this\ (?:job|advert|page|search) | ^report\ this\ | ^follow\ .{2,60}\ for\ | ^follow\ us | ^get\ new\ .{2,80}\ by\ (?:e-?)?mail | ^(?:sign\ up|subscribe|join|register)\b.{0,40}\b(?:letter|newsletter|alerts?|list|readers|updates)\b | ^(?:enter|leave|type)\ your\ (?:e-?mail|address) | ^no\ spam | ^create\ a\ free\b | ^download\ (?:the|our)\ .{2,60}\ app$ | \bjoin\ \d+\ readers
    | recevez\ les\ offres | par\ courriel$ | per\ e?-?mail\ erhalten | (?:empleos|ofertas)\ de\ .{2,60}\ por\ correo
    | ^\d+\s+(?:comments?|people|readers|views?|likes|kommentare|commentaires|comentarios)\b.{0,60}$ | ^be\ the\ first\ to\ comment
    | ^(?:you\ may\ also\ like|others?\ also\ |related\b|similar\ (?:roles|jobs|adverts)|more\ (?:from|jobs|roles|openings|stories)\b|other\ openings|jobs\ near|recommended|read\ (?:next|also)|sponsored\b|advertisement\b|trending|popular\b|see\ also|next:|previous:)
    | \d+\ new\ jobs\ in\b | \b\d+\ days\ ago\b | \breviews\ and\ salaries$ | :\ how\ i\ became\b
    | \bback\ to\ top$ | ^nach\ oben | \bhaut\ de\ (?:la\ )?page | ^(?:volver\ )?arriba$ | ^page\s+\d+\s+of\s+\d+ | ^sitemap$ | ^impressum | ^mentions\ l[ée]gales | ^aviso\ legal | ^datenschutz | \bvie\ priv[ée]e\b | ^(?:terms\ of\ use|privacy|terms|imprint|legal)\b.{0,10}(?:\s*[|/·].*)?$ | \|\ (?:privacy|terms|imprint)\b
    | \bnot\ responsible\ for\ adverts\b | \bare\ checked\ by\ hand,\ yet\b | \bname\ and\ mark\ belong\ to | \bof\ any\ listing\ needs\ written\ leave | \btreats\ every\ applicant\ alike | ^registered\ office | \bcompany\ number\ \d+ | ^contact\ us: | ^(?:help|press)\ cent(?:re|er)\b | ^made\ in\ .{2,40}\ with\ care | ^(?:powered|built|designed)\ by\b | \badverts?\ placed\ by\ third\ part
    """


def closing(pattern: str, start: int) -> int:
    """Place of the bracket that closes the one at ``start``."""
    depth, within, k = 0, False, start
    while True:
        c = pattern[k]
        if c == "\\":
            k += 1
        elif within:
            within = c != "]"
        elif c == "[":
            within = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        if not depth and not within:
            return k
        k += 1


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a verbose pattern, split where a bar stands outside brackets."""
    out, start, k = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c in "([":
            k = closing(pattern, k)
        elif c == "|":
            out.append(pattern[start:k])
            start = k + 1
        k += 1
    return [a.lstrip() for a in [*out, pattern[start:]]]


#: Letters that match others without regard to case, but whose small letter is another.
ODD_CASE = frozenset("ſıİK")


def cues(pattern: str) -> frozenset[str]:
    """Small-letter strings, one of which stands in whatever the verbose pattern matches; the empty one where none is sure."""
    out: frozenset[str] = frozenset()
    for part in alternatives(pattern):
        # what each match must hold: the runs of plain signs, and one of the cues of each group
        sure, run, k = [], "", 0
        while k < len(part):
            c, group = part[k], None
            plain = c not in "\\([.^$?*+{" or (c == "\\" and not part[k + 1].isalnum())
            end = closing(part, k) if c in "([" else part.index("}", k) if c == "{" else k + (c == "\\")
            if c == "(" and (part.startswith("(?:", k) or part[k + 1] != "?"):
                group = cues(part[k + 1 : end].removeprefix("?:"))
            k = end + 1
            optional = part[k : k + 1] in tuple("?*{")
            if plain and not c.isspace() and not optional:
                run += part[end].lower()
            elif not plain or optional:
                sure.append(frozenset([run]))
                run = ""
            if group and not optional:
                sure.append(group)
        out |= max([*sure, frozenset([run])], key=lambda found: (min(map(len, found)), -len(found)))
    return out


def finder(pattern: str) -> Callable[[str, str], bool]:
    """Whether a verbose pattern is found in a text, whose small letters come along, without regard to case: only the alternatives whose cues stand there are tried."""
    whole = re.compile(pattern, re.I | re.X).search
    tried = [(cue, re.compile(a, re.I | re.X).search) for a in alternatives(pattern) for cue in sorted(cues(a))]

    def found(text: str, small: str) -> bool:
        if not (text.isascii() or ODD_CASE.isdisjoint(text)):
            return whole(text) is not None
        for cue, search in tried:
            if cue in small and search(text):
                return True
        return False

    return found


BEGINS = re.compile("|".join(f"(?:{a})" for a in alternatives(PROMPTS) if a.startswith("^")), re.I | re.X).match
HOLDS = finder("|".join(f"(?:{a})" for a in alternatives(PROMPTS) if not a.startswith("^")))
#: A line can only match where it begins with one of the first words or holds one of the others.
FIRST_HINTS = frozenset(
    "liked advertise c copyright skip jump zum aller saltar ir toggle open main site menu menú we this our before your you by read ok okay manage accept reject allow deny settings only cookie "
    "wir diese nous ce usamos utilizamos este last updated modified changed published posted mis zuletzt actualizado modificado publicado min reading lesezeit temps tiempo filed tags "
    "tag category categories written reported von par por from share like enjoyed pass forward send tell partagez partager comparte compartir compartan teilen print save copy report follow "
    "get sign subscribe join register enter leave type no create download comments comment people readers reader views view likes kommentare commentaires comentarios be others other "
    "related similar more jobs recommended sponsored advertisement trending popular see next previous nach volver arriba page sitemap impressum mentions aviso datenschutz terms privacy imprint "
    "legal registered contact help press made powered built designed cookies".split()
)
OTHER_HINTS = frozenset(
    "rights derechos rechte droits partners aceptas acepta acepte cookies cookie stimmen acceptez acceptent traceurs geändert el readers offres courriel erhalten correo new ago salaries "
    "became top haut privée privee privacy terms imprint responsible checked mark listing applicant number advert adverts teilen empfehlen".split()
)
#: Pages and sites on which a line must come to be no content of any, and pages of one site.
LEAST_PAGES, LEAST_SITES, LEAST_OF_SITE = 6, 3, 6
REMEMBERED = 100_000


class Features:
    """What a line says of itself: kind (empty, link, text, item or short), letters, words, characters, tags, link tags."""

    __slots__ = ("bullet", "chars", "key", "kind", "link_tags", "repeats", "tags", "words")

    def __init__(self, raw: str):
        self.key, self.words, self.repeats, self.chars, self.tags, self.link_tags, self.bullet = "", 0, False, 0, 1, 0, False
        text = " ".join(raw.split())
        if text and (text[0] in "»›>" or text.endswith(("...", "…"))):
            text = DECORATION.sub("", text)
        if not text:
            self.kind = "empty"
            return
        self.chars = len(text)
        small = text.lower()
        spelt = WORDS.findall(small)
        self.key, words = "".join(spelt), len(spelt)
        self.words, self.repeats = words, words > 1 and len(set(spelt)) < words
        sentence = words >= 4 and text.rstrip(CLOSERS)[-1:] in STOPS
        links = 0
        if SIGN.search(text):
            links = len([x for x in SIGNS.split(text) if x.strip()])
        elif "  " in raw.strip():
            # menu entries set apart by wide gaps; a spread-out sentence has the same gap between all words
            parts = [x for x in GAPS.split(raw.strip()) if x]
            if len(parts) > 2 and (any(" " in x for x in parts) or all(x[:1].isupper() for x in parts)):
                links = len(parts)
        self.tags = max(1, links)
        if (
            ((not spelt or text[0] in "©(" or spelt[0] in FIRST_HINTS) and BEGINS(text))
            or (not OTHER_HINTS.isdisjoint(spelt) and (HOLDS(text, small) or BEGINS(text)))
            or (not sentence and ((links >= 2 and self.chars / links < 28 and not LABEL.match(text)) or RELATED.match(text)))
        ):
            self.kind, self.link_tags = "link", self.tags
        elif sentence or words >= 14:
            self.kind = "text"
        elif ITEM.match(text) or LABEL.match(text):
            self.kind, self.bullet = "item", ITEM.match(text) is not None
        else:
            self.kind = "short"


features = lru_cache(REMEMBERED)(Features)


class Leaf:
    """A line in its page: its features, and whether it is a link or comes again elsewhere."""

    __slots__ = ("bullet", "chars", "key", "kind", "link_chars", "link_tags", "number", "repeated", "repeats", "tags", "words")

    def __init__(self, number: int, raw: str, site: str = "", repeated: bool = False):
        f = features(raw)
        self.number, self.repeated, self.kind, self.key = number, repeated, f.kind, f.key
        self.words, self.repeats, self.chars, self.tags, self.link_tags, self.bullet = f.words, f.repeats, f.chars, f.tags, f.link_tags, f.bullet
        if site and f.key == site:
            self.kind = "link"
        self.link_chars = 0

    def settle(self, content: bool) -> None:
        """Fix what of the line is link, where the page has ``content`` that comes nowhere else."""
        if self.repeated and content and self.kind in ("text", "item"):
            self.kind = "link"
        if self.kind == "link":
            self.link_tags = self.tags
        if self.kind == "link" or (self.repeated and self.kind == "short"):
            self.link_chars = self.chars


def composite_density(chars: int, link_chars: int, tags: int, link_tags: int, page_chars: int, page_links: int) -> float:
    """Characters by tags, adjusted by what is link in the node and in the page; 0 where all is link."""
    if not chars or (chars == link_chars and tags == link_tags):
        return 0.0
    base = log(chars / max(1, chars - link_chars) * link_chars + page_links / max(1, page_chars) * chars + e)
    return chars / tags * log(max(1.0, chars / max(1, link_chars) * tags / max(1, link_tags))) / log(max(base, 1.5))


class Stretch:
    """A run of lines that are all link or all not, with its density and the sum of its lines' densities."""

    __slots__ = ("density", "leaves", "total")

    def __init__(self, leaves: list[Leaf], page_chars: int, page_links: int):
        self.leaves = leaves
        chars, link_chars = sum([x.chars for x in leaves]), sum([x.link_chars for x in leaves])
        tags, link_tags = sum([x.tags for x in leaves]), sum([x.link_tags for x in leaves])
        self.density = composite_density(chars, link_chars, tags, link_tags, page_chars, page_links)
        self.total = sum([composite_density(x.chars, x.link_chars, x.tags, x.link_tags, page_chars, page_links) for x in leaves])


def headline(filled: list[Leaf], title: str | None, first: int) -> int:
    """Place of the headline: the line that is the title, else a short line above the first text that is no menu entry."""
    key = "".join(WORDS.findall((title or "").lower()))
    if key:
        for k, leaf in enumerate(filled):
            if leaf.key == key:
                return k
    k = first - 1
    while k >= 0 and filled[k].kind == "link" and first - k <= 4:
        k -= 1
    if k < 0 or filled[k].kind != "short" or filled[k].words < 3:
        return -1
    menu = k > 0 and filled[k - 1].kind == "short" and filled[k - 1].words <= 3
    return k if filled[k].words >= 4 or not menu else -1


def menu_runs(leaves: list[Leaf]) -> set[int]:
    """Lines of menus that put one entry on a line: three or more lines of up to three words in a row."""
    out: set[int] = set()
    run: list[int] = []
    for leaf in [*leaves, None]:
        if leaf is not None and leaf.kind == "short" and leaf.words <= 3 and not leaf.repeats and (not run or leaf.number - run[-1] <= 2):
            run.append(leaf.number)
            continue
        if len(run) >= 3:
            out.update(run)
        run = []
    return out


def body_stretches(filled: list[Leaf]) -> list[Stretch]:
    """The stretches of the main body: those whose density reaches the least one on the way from the stretch of the greatest sum to the page."""
    chars, links = sum(leaf.chars for leaf in filled), sum(leaf.link_chars for leaf in filled)
    stretches = [Stretch(list(run), chars, links) for _, run in groupby(filled, key=lambda leaf: leaf.link_chars > 0)]
    # labels alone, cut off by links from all that speaks in sentences or lists, are pointers and no stretch of the body
    spoken = [s for s in stretches if s.leaves[0].link_chars or any(leaf.kind == "text" or leaf.bullet for leaf in s.leaves)]
    stretches = spoken if any(not s.leaves[0].link_chars for s in spoken) else stretches
    best = max(stretches, key=lambda s: s.total)
    page = composite_density(chars, links, sum(leaf.tags for leaf in filled), sum(leaf.link_tags for leaf in filled), chars, links)
    threshold = min(best.density, page)
    return [s for s in stretches if s.density >= threshold]


def main_body(text: str, title: str | None, site: str, repeated: frozenset[int] | set[int] = frozenset()) -> set[int]:
    """Numbers of the lines of the main body; ``repeated`` has the numbers of the lines that come again elsewhere."""
    leaves = [Leaf(k, raw, site, k in repeated) for k, raw in enumerate(text.split("\n"))]
    filled = [leaf for leaf in leaves if leaf.kind != "empty"]
    content = any((leaf.kind == "text" or leaf.bullet) and not leaf.repeated for leaf in filled)
    for leaf in filled:
        leaf.settle(content)
    dense = [k for k, leaf in enumerate(filled) if leaf.kind in ("text", "item")]
    if not dense:
        # no line is body-like: what stands in place of the content is what is no link text
        head = headline(filled, title, len(filled))
        kept = [leaf for leaf in filled[max(0, head) :] if leaf.kind != "link"]
        return {leaf.number for leaf in kept} - menu_runs(kept[1:] if head >= 0 else kept)
    head = headline(filled, title, dense[0])
    within = {leaf.number for stretch in body_stretches(filled) for leaf in stretch.leaves}
    body = {k for k, leaf in enumerate(filled) if k > head and leaf.number in within and leaf.kind != "short"}
    spoken = set(body)
    if head >= 0:
        body.add(head)
    for k in range(len(filled) - 2, head, -1):
        # a subheading stands before what belongs to the body, or where a sidebar parts it from that; not above the beginning,
        # and one that comes again elsewhere stands between two lines of the body
        before, after = k - 1 in (spoken if filled[k].repeated else body), k + 1 in body
        if filled[k].kind == "short" and (before and after if filled[k].repeated else (head >= 0 or k > dense[0]) and (after or (before and k < dense[-1]))):
            body.add(k)
    return {filled[k].number for k in body}


def site_key(domain: str | None) -> str:
    """Letters of a site's name without its last label."""
    return "".join(WORDS.findall((domain or "").lower().rsplit(".", 1)[0]))


def _pages(documents: DataFrame, results: DataFrame) -> DataFrame:
    """(field, row_id, title, domain, text) of stored and fetched pages."""
    stored = narrow(documents, row_id="source_document_id", title="title", domain="domain", text="raw_content").where("row_id IS NOT NULL AND text IS NOT NULL")
    host = F.regexp_extract(F.col("url"), r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    fetched = narrow(results, row_id="result_id", title="title", url="final_url", text="text").where("row_id IS NOT NULL AND text IS NOT NULL")
    columns = ("row_id", "title", "domain", "text")
    return stored.select(F.lit("raw_content").alias("field"), *columns).unionByName(fetched.withColumn("domain", host).select(F.lit("text").alias("field"), *columns))


def line_keys(pages: DataFrame) -> DataFrame:
    """(field, row_id, domain, keys): a digest of the letters of each line, the site's name in them left out; null for lines without letters."""
    letters = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{M}]+", ""))
    site = F.coalesce(F.nullif(letters(F.regexp_replace("domain", r"\.[^.]*$", "")), F.lit("")), F.lit("\u0000"))
    keyed = pages.withColumn("site", site).select(
        "field", "row_id", "domain", F.transform(F.split("text", "\n"), lambda line: F.replace(letters(line), F.col("site"), F.lit("~"))).alias("letters")
    )
    return keyed.select("field", "row_id", "domain", F.transform("letters", lambda x: F.when(x != "", F.xxhash64(x))).alias("keys"))


def repeated_numbers(pages: DataFrame) -> DataFrame:
    """(field, row_id, repeated): for each page the numbers of its lines that come on enough pages of enough sites, or of their own."""
    keys = durable(line_keys(pages))
    # a page has a line once, however often it repeats it; counts add up before they are shuffled
    by_site = keys.select("domain", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key")).groupBy("key", "domain").agg(F.count(F.lit(1)).alias("n"))
    spread = durable(by_site.groupBy("key").agg(F.sum("n").alias("pages"), F.count("domain").alias("sites"), F.max("n").alias("most")).where((F.col("most") >= LEAST_OF_SITE) | ((F.col("pages") >= LEAST_PAGES) & (F.col("sites") >= LEAST_SITES))))
    everywhere = spread.where((F.col("pages") >= LEAST_PAGES) & (F.col("sites") >= LEAST_SITES)).select("key")
    own = by_site.where(F.col("n") >= LEAST_OF_SITE).join(everywhere, "key", "left_anti").select("key", "domain")
    lines = keys.select("field", "row_id", "domain", F.posexplode("keys").alias("line_no", "key")).where("key IS NOT NULL")
    marked = lines.join(everywhere, "key", "left_semi").unionByName(lines.join(own, ["key", "domain"], "left_semi").select("key", "field", "row_id", "domain", "line_no"))
    return marked.groupBy("field", "row_id").agg(F.collect_set("line_no").alias("repeated"))


def marked_pages(documents: DataFrame, results: DataFrame) -> DataFrame:
    """(field, row_id, title, domain, text, repeated) of all pages."""
    pages = _pages(documents, results)
    return pages.join(repeated_numbers(pages), ["field", "row_id"], "left").select("field", "row_id", "title", "domain", "text", "repeated")


def boilerplate_lines(documents: DataFrame, results: DataFrame) -> DataFrame:
    """(field, row_id, line_no) of the lines of stored and fetched pages that are no main body."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, ids, numbers = [], [], []
            for field, row, title, domain, text, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                body = main_body(text, title, site_key(domain), frozenset(repeated or ()))
                gone = [k for k, line in enumerate(text.split("\n")) if k not in body and line.strip()]
                fields += [field] * len(gone)
                ids += [row] * len(gone)
                numbers += gone
            yield pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(ids, pa.int64()), pa.array(numbers, pa.int64())], ["field", "row_id", "line_no"])

    found = marked_pages(documents, results).mapInArrow(scan, "field string, row_id bigint, line_no bigint")
    return found.dropDuplicates(["field", "row_id", "line_no"])


def main_bodies(documents: DataFrame, results: DataFrame) -> DataFrame:
    """(field, row_id, body): the main body of every page, its lines in order."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for title, domain, text, repeated in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                body = main_body(text, title, site_key(domain), frozenset(repeated or ()))
                out.append("\n".join(line for k, line in enumerate(text.split("\n")) if k in body))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["field", "row_id", "body"])

    return marked_pages(documents, results).mapInArrow(keep, "field string, row_id bigint, body string")
