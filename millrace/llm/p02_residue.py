"""Results that hold template residue, filler, an error page or a notice about scripts instead of content.

Two kinds of evidence are gathered and joined in small aggregates.

Slots. Text marked in an unmistakable way as a variable ({{x}}, ${x}, <%= x %>, %%x%%, ...) is an
unfilled slot; the names found there over the whole corpus are the known variables, and so is a
weaker mark ([x], {x}, TODO: x) that holds one of them. The records of one template are aligned
line by line: what a line leaves when capitalised words, numbers and marks are taken out is its
skeleton, the places taken out are the slots, and the skeletons of all lines of all records are
compared. Where enough records fill a skeleton and differ there, a record that leaves a slot
blank, at a default, or at a variable's name written as an identifier (CompanyName, job_title;
its parts are those of the known variables) is flagged. A sentence that explains such marks is
no template.

Pages. The lines of a page's main body, its headline left out, are compared over the corpus:
lines that come word for word on many pages of several sites, with no name in them, are page
templates. A page whose lines are all page templates, or speak as filler, errors and script
notices do, has no content. Whether a line speaks so is asked of the longest line first and no
further than to the first that does not; only the pages on which that one is a page template
are read a second time.

Defined results: null and blank title and text are no case by themselves; a page of headline
and menus only is no case; results with a null id are left out; repeated rows come out once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm.common import durable, narrow
from millrace.llm.p06_boilerplate import features, finder, main_body

#: Pages and sites on which a body line must come word for word to count as a page template.
LEAST_PAGES, LEAST_SITES = 6, 4
#: Records that fill a slot of one skeleton, from which a blank there counts.
LEAST_FILLED = 5
NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_.\-][A-Za-z0-9]+)*"
#: Marks that nothing but a template uses.
MARKED = re.compile(
    rf"\{{\{{\s*({NAME})\s*(?:\|[^{{}}]*)?\}}\}}|\$\{{\s*({NAME})\s*\}}|#\{{\s*({NAME})\s*\}}|<%=?\s*({NAME})\s*%>|\{{%\s*(?:if|for|else|set|include)?\s*({NAME})[^%]*%\}}|%%({NAME})%%|@@({NAME})@@"
    rf"|\[\[\s*({NAME})\s*\]\]|\[(?:insert|add|enter|your)\s+({NAME})(?:\s+here)?\]|<(?:your|insert|add)\s+({NAME})>|\bXX_({NAME})_XX\b|(?<![A-Za-z0-9_])__({NAME})__(?![A-Za-z0-9_])",
    re.IGNORECASE,
)
#: Marks that are a slot only around a known variable.
WEAK = re.compile(rf"(?<![\[\w])\[({NAME})\](?!\])|(?<![{{$#\w])\{{({NAME})\}}(?!\}})|\bTODO:\s*({NAME})", re.IGNORECASE)
SIGNS = (*"{}[]%@<", "XX_", "__", "TODO")
MENTION = re.compile(r"(?i)\bsuch as\b|\bfor example\b|\be\.g\.|\bexplains?\b|\bsyntax\b|\bdouble braces\b|\bis written\b|\bplaceholders?\b.*\blike\b")
#: What pages without content say, in the corpus's four languages.
FAULTS = r"""
    \b(?:enable|turn\ on|allow|activate|activez|activer|activar|activa|aktivieren?)\b.{0,25}\b(?:java\ ?script|scripts)\b | \bjava\ ?script\ is\ (?:disabled|off|required|needed|not)
    | \b(?:needs|requires|blocks|blocking)\ (?:java)?scripts?\b | \bnoscript\b | ^loading\b | \bscripts\ (?:are\ allowed|switched\ off)\b
    | ^(?:error\ )?[45]\d\d\b\ ?(?:[-–:|]|error|not\ found|forbidden|$) | \berror\ \d{3}\b | ^(?:oops|whoops)\b | ^.{0,25}\bnot\ found\b(?!\ errors) | \bno\ longer\ (?:exists|available)\b
    | ^.{0,24}\bpage\ is\ gone\b | \bcould\ not\ find\ what\b | ^.{0,20}could\ not\ be\ found | \bleads\ nowhere\b | ^something\ (?:broke|went\ wrong) | \btry\ again\ (?:in|later)\b | ^invalid\ (?:request|token) | \bgo\ back\ and\ reloa
    | \bdown\ for\ (?:upkeep|maintenance)\ until\b | \bnot\ allowed\ to\ (?:see|view)\b | \baccess\ (?:denied|to\ this\ page) | ^forbidden\b | \bsession\ (?:ran\ out|expired|has\ expired|timed) | \btimed\ out\ after\b
    | \bserver\ gave\ no\ answer | ^(?:database\ )?.{0,12}connection\ (?:lost|refused|reset)\b | \bprove\ that\ you\ are\b | ^too\ many\ requests | \bnicht\ gefunden\b | \bn['’]existe\ plus\b | ^page\ introuvable | \bno\ encontramos\ la\b | \bp[áa]gina\ no\ (?:existe|encontrada)
    | \bunhandled\ exception\b | \bnull\ (?:reference|pointer)\b | ^(?:fatal|internal)\ (?:server\ )?error\b | ^traceback\b | \bexception\ in\ (?:module|thread)\b
    | ^code:\ \w+ | ^ref(?:erence)?:?\ [\w-]+$ | \bsign\ in\ again\b | \btemporarily\ unavailable\b | ^back\ to\ the\ (?:start|home)\ ?page | ^try\ the\ search\b
    | \blorem\ ipsum\b | ^sample\ (?:text|page)\b | \bdummy\ (?:copy|text)\b | ^placeholder\b | \byour\ (?:headline|text|title|content)\ (?:here|goes\ here)\b | \btext\ goes\ here\b | ^type\ something\ about\b | ^(?:add|write|enter)\ a\ short\ description\b
    | ^(?:content|text|more)\ will\ follow\b | ^coming\ soon\b | ^under\ construction\b | \bkommt\ bald\b | \bbeispieltext\b | \bblindtext\b | \btexte\ d['’]exemple\b | \btexto\ de\ (?:ejemplo|relleno|muestra)\b | \bfor\ your\ own\ words\b
    """
FAULT = finder(FAULTS)
#: Function words of the corpus's languages; a sentence without any is no sentence.
FUNCTION_WORDS = frozenset(
    "a an the of to in on at for and or but is are was were be by with from as that this it we you they he she his her its our your their not no so if than then who which when where had has "
    "have will would can may must after before up out over about more all says said der die das den dem des ein eine einen einem und oder in im am auf für mit von zu zum zur bei ist sind war wird "
    "werden hat nicht auch nur sich nach laut wer le la les un une des de du et ou en dans pour par avec sur est sont a ont sera que qui ne pas au aux près selon chez el los las una y o del por "
    "para con es son está que se su al va".split()
)
TOKENS = re.compile(r"[^\W\d_]+").findall
NUMBER = re.compile(r"\d+")
LEARNED = frozenset(("company", "name", "role", "title", "city", "location"))


def squeezed(line: str) -> str:
    """A line with one space between words and its numbers taken out."""
    return NUMBER.sub("0", " ".join(line.split())).strip("»›> .…").lower()


def filler_words(line: str) -> bool:
    """Word salad: repeated words, or many words and no function word among them."""
    found = TOKENS(line.lower())
    if len(found) < 3:
        return bool(found) and len(set(found)) == 1 and len(found) > 1
    if len(set(found)) <= 2 and len(set(found)) < len(found):
        return True
    small = [t for t in TOKENS(line) if t.islower()]
    return len(found) >= 6 and len(small) >= 0.6 * len(found) and FUNCTION_WORDS.isdisjoint(found)


def fault(line: str) -> bool:
    text = " ".join(line.split()).lstrip("»›> ")
    small = text.lower()
    if FAULT(text, small):
        return True
    words = small.split()
    # a function word among three different words: no salad, without a closer look
    if not FUNCTION_WORDS.isdisjoint(words) and len({w for w in words if w.isalpha()}) >= 3:
        return False
    return filler_words(text)


def marks(text: str) -> tuple[list[str], list[str]]:
    """Variables in unmistakable marks, and in weaker ones, of a text's lines that are no explanation."""
    strong, weak = [], []
    for line in text.split("\n"):
        if not any(map(line.__contains__, SIGNS)) or MENTION.search(line):
            continue
        strong += ["".join(g).lower() for g in MARKED.findall(line)]
        weak += ["".join(g).lower() for g in WEAK.findall(line)]
    return strong, weak


def page_lines(text: str, title: str | None) -> list[str]:
    """The body's lines without its headline."""
    lines = text.split("\n")
    body = [lines[k] for k in sorted(main_body(text, title, "")) if lines[k].strip()]
    head = "".join(TOKENS((title or "").lower()))
    rest = [x for x in body if not head or features(x).key != head]
    if len(rest) == len(body) and len(rest) > 1 and not fault(rest[0]) and features(rest[0]).kind == "short":
        rest = rest[1:]
    return rest


def digest(text: str) -> int:
    """64 bits that stand for a text where only equality counts."""
    value = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


EVIDENCE = "result_id bigint, site string, strong array<string>, weak array<string>, lines array<bigint>, stop bigint, unfilled array<string>, names array<struct<name: string, line: string>>"
JUDGED = "result_id bigint, line bigint, fault boolean"
#: What templates put where nothing is filled in.
DEFAULT = re.compile(
    r"\b(?:Company|Employer|Role|City|First|Last|Job) (?:Name|Title)(?: Here)?\b|\b(?:Your|YOUR) (?:Company|Name|Role|City|COMPANY|NAME|ROLE|CITY)\b|\b(?:null|undefined|TBD|TBA|N/A|XXX+)(?!\w)|_{3,}"
)
#: A preposition or greeting right before a sign, or empty brackets: a slot may be blank there.
BLANK = re.compile(r"\b(?:at|to|in|for|of|by)(?=\s+[,.;:])|\bDear(?=\s*,)|\((?=\s*\))")
#: A name written as an identifier.
IDENTIFIER = re.compile(r"\b(?:[A-Za-z][a-z]+(?:[A-Z][a-z]+)+|[A-Za-z]+(?:_[A-Za-z]+)+)\b")
#: Without one of these, found at once, a line has no blank, default or identifier.
HINTS = r"{space}[,.;:]|Dear{space}*,|\({space}*\)|(?:Name|Title|NAME|ROLE|CITY|Your|YOUR|null|undefined|TB[DA]|N/A|XXX)\b|_|[a-z][A-Z]"
HINT = re.compile(HINTS.replace("{space}", r"\s"))
#: The same and more in the syntax of Arrow, whose \b knows ASCII only.
ROUGH_HINT = HINTS.replace("{space}", r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]")


def hinted_lines(texts: pa.Array) -> list[list[str]]:
    """The lines of each text that may have a hint, found for all texts at once."""
    out: list[list[str]] = [[] for _ in range(len(texts))]
    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    hit = pc.match_substring_regex(lines, ROUGH_HINT)
    for k, line in zip(pc.list_parent_indices(split).filter(hit).to_pylist(), lines.filter(hit).to_pylist(), strict=True):
        out[k].append(line)
    return out


def unfilled_lines(lines: list[str]) -> tuple[list[str], list[dict[str, str]]]:
    """Lines with a slot left blank or at a default, \u0002 in its place, and the lines that hold identifiers, by identifier."""
    whole, names = [], []
    for line in lines:
        if not HINT.search(line):
            continue
        if BLANK.search(line) or DEFAULT.search(line):
            whole.append(BLANK.sub(lambda m: m[0] + " \u0002", DEFAULT.sub("\u0002", MARKED.sub("\u0002", WEAK.sub("\u0002", line)))))
        names += [{"name": name, "line": line.replace(name, "\u0002")} for name in set(IDENTIFIER.findall(line))]
    return whole, names


def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of each record, its lines with an unfilled slot, its body's lines, and the first of them, the longest first, that does not speak as a fault."""
    texts = pa.list_(pa.string())
    types = [pa.int64(), pa.string(), texts, texts, pa.list_(pa.int64()), pa.int64(), texts, pa.list_(pa.struct([("name", pa.string()), ("line", pa.string())]))]
    for batch in batches:
        rows = []
        for row, site, title, text, hinted in zip(*(batch.column(k).to_pylist() for k in range(4)), hinted_lines(batch.column(3)), strict=True):
            both = f"{title or ''}\n{text or ''}"
            strong, weak = marks(both) if any(map(both.__contains__, SIGNS)) else ([], [])
            rest = page_lines(text, title) if text and text.strip() else []
            lines = [digest(squeezed(x)) for x in rest]
            stop = next((lines[k] for k in sorted(range(len(rest)), key=lambda k: -len(rest[k])) if not fault(rest[k])), None)
            rows.append((row, site, sorted(set(strong)), sorted(set(weak)), lines, stop, *unfilled_lines(hinted)))
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["result_id", "site", "strong", "weak", "lines", "stop", "unfilled", "names"])


def judged_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every body line of a record and whether it speaks as a fault."""
    for batch in batches:
        rows = [(row, digest(squeezed(x)), fault(x)) for row, title, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for x in page_lines(text, title)]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.column(0).type, pa.int64(), pa.bool_()], strict=True)], ["result_id", "line", "fault"])


#: A slot in the syntax of the JVM: capitalised words, numbers, and \u0002 for whatever was marked as one.
SLOT = r"[\u0002\p{Lu}\d][\p{L}\p{N}_'’-]*"
#: A skeleton has three words outside its slots: a sentence, not a heading or a menu.
SPEAKS = r"\p{L}+[^\p{L}]+\p{L}+[^\p{L}]+\p{L}"


def skeleton(line: Column) -> Column:
    """A line with one \u0002 for each run of slots; white space beside slots does not count."""
    marked = F.regexp_replace(line, SLOT, "\u0002")
    return F.trim(F.regexp_replace(marked, r"[\t ]*\u0002[\t \u0002]*", "\u0002"))


def unfilled(found: DataFrame, texts: DataFrame, variables: DataFrame) -> DataFrame:
    """(result_id) of the records with a slot that is blank, at a default or at a variable's name where others of the template fill it.

    ``found`` has the lines of each record with such a slot, ``variables`` the names of the known variables.
    """
    # identifiers count where all their parts are parts of known variables
    parts = lambda c: F.split(F.lower(F.regexp_replace(c, r"([a-z])([A-Z])", "$1_$2")), r"[_.\-]")
    known = variables.select(F.explode(parts(F.col("variable"))).alias("part")).union(found.sparkSession.createDataFrame([(w,) for w in sorted(LEARNED)], "part string")).distinct()
    written = found.where(F.size("names") > 0).select("result_id", F.explode("names").alias("w")).select("result_id", "w.name", "w.line")
    split = written.select("result_id", "name", "line", F.size(parts(F.col("name"))).alias("n"), F.explode(parts(F.col("name"))).alias("part")).join(known, "part", "left_semi")
    named = split.groupBy("result_id", "name", "line").agg(F.count(F.lit(1)).alias("held"), F.first("n").alias("n")).where("held = n").select("result_id", F.col("line").alias("whole"))
    plain = found.where(F.size("unfilled") > 0).select("result_id", F.explode("unfilled").alias("whole"))
    bare = plain.unionByName(named).select("result_id", skeleton(F.col("whole")).alias("shape")).where(F.col("shape").rlike(SPEAKS)).select("result_id", F.xxhash64("shape").alias("shape"))
    bare = durable(bare.distinct())
    if bare.isEmpty():
        return bare.select("result_id")
    lines = texts.select("result_id", F.explode(F.split("text", "\n")).alias("line"))
    filled = lines.select("result_id", F.xxhash64(skeleton(F.col("line"))).alias("shape"), F.xxhash64("line").alias("line"))
    # only the skeletons that some record leaves unfilled are aligned any further; the unfilled records themselves fill nothing
    aligned = filled.join(bare.select("shape").distinct(), "shape", "left_semi").join(bare, ["shape", "result_id"], "left_anti")
    # the lines of one skeleton differ in their slots alone
    templates = aligned.groupBy("shape").agg(F.countDistinct("result_id").alias("n"), F.min("line").alias("a"), F.max("line").alias("b")).where((F.col("n") >= LEAST_FILLED) & (F.col("a") != F.col("b")))
    return bare.join(templates.select("shape"), "shape", "left_semi").select("result_id")


def residue(results: DataFrame) -> DataFrame:
    """(result_id, reason) of the results without content or with template residue."""
    source = narrow(results, result_id="result_id", url="final_url", title="title", text="text").where("result_id IS NOT NULL AND (title IS NOT NULL OR text IS NOT NULL)")
    source = source.select("result_id", F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1).alias("site"), "title", "text")
    found = durable(source.mapInArrow(evidence, EVIDENCE))  # read by each of the aggregates below
    slots = found.where(F.size("strong") > 0).select("result_id")
    variables = durable(found.select(F.explode("strong").alias("variable")).distinct())
    weak = found.where(F.size("weak") > 0).select("result_id", F.explode("weak").alias("variable"))
    known = weak.join(variables, "variable", "left_semi").unionByName(weak.where(F.col("variable").isin(sorted(LEARNED))))
    blank = unfilled(found, source.where("text IS NOT NULL").select("result_id", "text"), variables)
    # pages: each line of a body, and on how many pages and sites it comes word for word
    once = found.select(F.explode(F.array_distinct("lines")).alias("line"), "site", "result_id").distinct()
    by_site = once.groupBy("line", "site").agg(F.count(F.lit(1)).alias("n"))
    common = durable(by_site.groupBy("line").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("sites")).where((F.col("pages") >= LEAST_PAGES) & (F.col("sites") >= LEAST_SITES)).select("line"))
    faults = found.where("size(lines) > 0 AND stop IS NULL").select("result_id")
    # the first line that speaks as no fault is a page template here: the other lines decide
    again = found.where("stop IS NOT NULL").select("result_id", F.col("stop").alias("line")).join(common, "line", "left_semi").select("result_id")
    pages = source.where("text IS NOT NULL").select("result_id", "title", "text").join(again.distinct(), "result_id", "left_semi").mapInArrow(judged_lines, JUDGED)
    judged = pages.join(common.withColumn("common", F.lit(True)), "line", "left")
    empty = judged.groupBy("result_id").agg(F.min(F.col("fault") | F.coalesce("common", F.lit(False))).alias("all")).where("all").select("result_id")
    reasons = [(slots, "slot"), (known.select("result_id"), "slot"), (blank, "blank"), (faults, "page"), (empty, "page")]
    parts = [df.select("result_id", F.lit(reason).alias("reason")) for df, reason in reasons]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def residual_results(results: DataFrame) -> DataFrame:
    """(result_id) of the results to keep out of extraction."""
    return residue(results).select("result_id").distinct()


def clean_results(results: DataFrame) -> DataFrame:
    """The results that go on to extraction, all their columns."""
    return results.join(residual_results(results), "result_id", "left_anti")
