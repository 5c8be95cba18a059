"""Problem 8: template residue, filler, error pages and script notices.

Slots are induced from the corpus.  Anything between marks in prose (``{{name}}``,
``<% owner %>``, ``[your team]``, a blank ...) is keyed by the words around it, which
aligns the records made from one template.  Where the aligned records hold several
notations at the same place, that place is a slot nobody filled.  A notation whose
marks mostly stand in such slots is a notation of placeholders, and counts elsewhere
too; a mark that texts merely discuss stands in code, in quotes or beside words about
placeholders and keeps one notation.

Pages are induced likewise.  The sentences of all texts are aligned with numbers and
identifiers left out; sentences that recur over texts which otherwise differ are
furniture, and a whole page that recurs with nothing but its numbers changed is a page
template.  A text of any length is a page without content if hardly a word of it is
left once furniture, known page wording and filler are taken away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adherix.session import broadcast_below, cut

#: A sentence is furniture, and a page a template, if so many different texts hold it.
RECURS = 4
#: Share of the marks of a notation that stand in induced slots, from which it is one of placeholders.
INDUCED = 0.5

# Marks: an opening and a closing run of signs around a name, or a blank.
_MARKS = re.compile(
    r"""(?<![\w{}\[\]<>%@\#$~^|&=])
    (?:(?P<open>\$\(|%\(|[{\[<%@\#$~^|&]{1,3}[=\-!*]?|__)(?P<name>\s?[^\W_](?:[\w.\-]|\ (?!\ ))*?\s?)(?P<close>[\-*!=]?[}\]>%@\#~^|&]{1,3}|\)s?|__)
    |(?P<blank>_{3,}))
    (?![\w{}\[\]<>%@\#$~^|&=])""",
    re.X,
)
_PAIRS = str.maketrans("([{<", ")]}>")
# Notations that are of placeholders wherever they stand in prose, a name written as a.
_KNOWN = frozenset("{{a}} {{{a}}} {%a%} {%=a%} <%a%> <%=a%> <%-a%> <%-a-%> <%=a-%> <%!a%> ${a} #{a} [[a]] <<a>> %%a%% @@a@@ __a__ [%a%] {#a#} $(a)".split())
# Notations that code and markup share; they count only where aligned records hold several notations.
_SHARED = ["{a}", "[a]", "<a>", "%a%", "%(a)s", "|a|", "&a&", "<a/>", "_"]
_RETAINED = ["{a}", "%a%", "%(a)s", "_"]
# Names that ask to be replaced, whatever the signs around them.
_ASKS = re.compile(r"^(?:your|insert|enter|add|replace)[ _\-]\w|\b(?:goes[ _\-])?here$", re.I)
# Words with which a text speaks about placeholders.
_ABOUT = re.compile(r"\b(?:placeholders?|template engine|templating|interpolat\w*|substitut\w*|syntax|notation|variables?|literal\w*|escap\w+|(?:tag|marker|token|string|word|snippet|pattern|expression)s? (?:in|like|such)|such as|plantilla|Platzhalter|Vorlage|gabarit|marcador)\b|\b(?:gets?|is|are) (?:replaced|filled|expanded|rendered)\b", re.I)
_LIKELY = re.compile(r"[{\[<%@#$~^|&]\s?\w|[=\-!*]\s?[^\W\d_]|\$\(|%\(|__")
_FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_INLINE = re.compile(r"(`+)(?=[^`])[^\n]*?[^`]\1(?!`)")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|(?<!\w)'[^'\n]*'(?!\w)|«[^»\n]*»|‘[^’\n]*’")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)|\n+")
_CODE = re.compile(r"[;{}=]|=>|\w\(\S|\breturn\b|\bdef \w|\bconst\b|\bfunction\b")
_WORD = re.compile(r"\w+")

# Wording of pages without content, in English, German, French and Spanish.
_PAGE = [
    r"(?:error|fehler|erreur|error:)\s*(?:code)?[:\s]*[1-5]\d\d\b(?:\s*[-:–]\s*[^\n.]{0,40})?",
    r"\b[45]\d\d\s+(?:not found|forbidden|unauthorized|bad request|bad gateway|service unavailable|internal server error|gateway time-?out|too many requests|gone|request timeout|conflict)\b",
    r"\b(?:internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|too many requests)\b",
    r"\b(?:page|file|repository|document|resource) (?:was )?not found\b|\bnot found\s*$",
    r"\baccess (?:is |was )?denied\b(?! pages)|\bpermission denied\b|\bunauthori[sz]ed\b",
    r"(?:sorry, )?we (?:couldn'?t|could not|can'?t|cannot) find (?:what|the) [^\n.]{0,60}\.?",
    r"the (?:server|upstream|service|site) (?:is|did|was|has|could)[^\n.]{0,80}(?:request|time|answer|unavailable|respond|overloaded|maintenance)[^\n.]{0,40}\.?",
    r"(?:please )?try again (?:later|in a (?:few )?(?:minutes?|moments?)[^\n.]{0,20})\.?",
    r"an (?:unexpected|internal|unknown) error (?:has )?occurred[^\n.]{0,60}\.?",
    r"(?:oops|whoops|uh oh)\s*[!.,]*|something went wrong(?:[,.]? please try again[^\n.]{0,20})?\.?",
    r"the requested (?:file|url|page|resource|repository|document)[^\n.]{0,80}\.?",
    r"the link (?:may|might) be broken[^\n.]{0,80}\.?|the page (?:you|may|might|has|was|does)[^\n.]{0,80}\.?",
    r"if you typed the address[^\n.]{0,60}\.?",
    r"you (?:don'?t|do not) have (?:permission|access|the rights)[^\n.]{0,60}\.?",
    r"(?:your|this|the) session (?:has )?(?:expired|timed out|ended)\.?|please (?:sign|log) in(?: again)?[^\n.]{0,40}\.?",
    r"this (?:page|content|file|repository) (?:isn'?t|is not|is no longer|is temporarily|is too large|does(?:n'?t| not))[^\n.]{0,60}\.?",
    r"(?:please )?contact (?:the|your|an) (?:system )?(?:administrator|admin|support)[^\n.]{0,60}\.?",
    r"\b(?:back to (?:home|the home ?page|start)|go (?:back|home)|report this problem|reload(?: (?:the|this) page)?|return to [^\n.]{0,30}|home ?page)\b",
    r"(?:ref|ray|request|incident|vorgang|trace|error|correlation|reference)\.?\s*(?:id|no|number)?\.?[:#]?\s*[0-9a-f\-]{6,}(?:\s*[-–]\s*[^\n.]{0,30})?",
    r"(?<!\w)(?:\w{2,20}d|nginx|apache|openresty|caddy|varnish|iis|cloudfront|server)/\d+(?:\.\d+)+",
    r"traceback \(most recent call last\):(?:\s*file \"[^\"\n]*\", line \d+, in \S+)*(?:\s*[^\n]{0,80}?)?(?:\w+(?:error|exception)\b[^\n]{0,60})?",
    r"(?:^|\n)\s*(?:file \"[^\"\n]*\", line \d+, in \S+|at [\w.$<>]+\([^)\n]*\)|[\w.]+(?:error|exception)(?::[^\n]{0,80})?)\s*(?=\n|$)",
    # scripts and browsers
    r"(?:please |you (?:need|have) to |you must )?(?:enable|activate|turn on|allow) (?:javascript|scripts?|cookies)[^\n.]{0,80}\.?",
    r"(?:javascript|scripts?|cookies) (?:is|are|must be|has to be|have to be|seems? to be) (?:disabled|required|needed|enabled|turned off|blocked|switched off)(?: in your browser| to [^\n.]{0,40})?\.?",
    r"(?:this|the) (?:site|page|app(?:lication)?|viewer|website|tool) (?:requires?|needs?|works? (?:only|best) with|cannot (?:load|run|work) without) (?:javascript|scripts?|cookies|a (?:modern|newer|supported) browser)[^\n.]{0,40}\.?",
    r"turn (?:them|it|javascript|scripts) on in your browser[^\n.]{0,40}\.?|we use cookies and scripts[^\n.]{0,80}\.?",
    r"noscript:?[^\n.]{0,80}\.?",
    r"your browser (?:is|isn'?t|is not|does(?:n'?t| not))[^\n.]{0,60}\.?(?:\s*(?:please )?(?:update|upgrade)[^\n.]{0,60}\.?)?|(?:please )?(?:update|upgrade) (?:it|your browser)[^\n.]{0,60}\.?",
    r"checking your browser[^\n.]{0,60}\.?|this (?:process |check )?takes a few seconds\.?|verify (?:that )?you are (?:a )?human[^\n.]{0,60}\.?|just a moment\.*",
    # German, French, Spanish
    r"(?:diese|die) (?:anwendung|seite|angeforderte|website)[^\n.]{0,80}(?:skripte?|javascript|existiert nicht|gefunden|verfügbar|verfuegbar|benötigt)[^\n.]{0,40}\.?",
    r"bitte (?:aktivieren|versuchen|melden|wenden|erlauben|schalten) sie[^\n.]{0,80}\.?|seite nicht gefunden|(?:dienst|server|seite) (?:ist )?(?:derzeit |zurzeit )?nicht (?:verfügbar|erreichbar)|sie haben keine berechtigung[^\n.]{0,40}\.?|zugriff verweigert|interner serverfehler|javascript ist (?:deaktiviert|erforderlich)[^\n.]{0,40}\.?|zurück zur startseite|ihre sitzung ist abgelaufen[^\n.]{0,20}\.?",
    r"(?:cette|la) (?:application|page|site)[^\n.]{0,60}(?:besoin de scripts|javascript|introuvable|n'existe|indisponible)[^\n.]{0,40}\.?|veuillez (?:activer|réessayer|vous|autoriser|contacter)[^\n.]{0,80}\.?|le fichier demandé[^\n.]{0,60}\.?|vous n'(?:avez|êtes) pas[^\n.]{0,60}\.?|erreur interne(?: du serveur)?|page (?:introuvable|non trouvée)|accès (?:refusé|interdit)|service indisponible|retour à l'accueil|votre session a expiré\.?",
    r"(?:esta|la) (?:aplicación|página|sitio)[^\n.]{0,60}(?:necesita|requiere|javascript|no (?:existe|encontrada|disponible))[^\n.]{0,40}\.?|activ[ae] (?:javascript|los scripts)[^\n.]{0,60}\.?|vuelva a intentarlo[^\n.]{0,40}\.?|no tiene permiso[^\n.]{0,60}\.?|el archivo solicitado[^\n.]{0,60}\.?|volver al inicio|página no encontrada|acceso (?:denegado|prohibido)|error interno(?: del servidor)?|servicio no disponible|su sesión ha (?:caducado|expirado)\.?",
]
_FILLER = [
    r"\b(?:(?:blah|bla|asdf|qwerty|foo|xxx+|test|dummy)[\s,.]+){1,}(?:blah|bla|asdf|qwerty|foo|xxx+|test|dummy)\b(?:\s+\d+)?\.?",
    r"\b(?:placeholder|sample|dummy|filler|example) (?:text|paragraph|content|sentence)\b[^\n.]{0,40}\.?",
    r"\b(?:your|the|some|more) (?:text|content|title|description|summary|paragraph)(?: (?:goes|comes|here|go))+[^\n.]{0,20}\.?|\b(?:text|content|title|description|summary) goes here\b[^\n.]{0,20}\.?",
    r"\b(?:coming soon|to be (?:written|done|added|determined|announced|completed)|under construction|replace me|untitled(?: section| document)?|intentionally left blank|this section is intentionally[^\n.]{0,30})\b\.?",
    r"(?:^|\n)\s*(?:[#>*\-]\s*)*(?:tbd|tba|todo|n/a|fixme|none|heading \d+|title|subtitle|item \d+|text)\s*[.!]?\s*(?=\n|$)",
    r"\b(?:add|write|insert|put|enter|describe) (?:a |an |the |your |some )?(?:short |brief )?(?:description|summary|text|diagram|introduction|content|overview|image|example|details?)\b[^\n.]{0,50}\.?",
    r"\bdescription of the (?:project|module|package|repository|feature)\b\.?",
]
# The vocabulary of the usual Latin filler.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vivamus mauris ornare lectus porta tellus vitae pellentesque morbi vestibulum praesent nunc donec integer quisque suspendisse curabitur aenean cras fusce etiam".split()
)
# Words of which each wording above holds at least one.
_TRIGGERS = frozenset(
    """upstream overloaded maintenance requests request error fehler erreur 400 401 403 404 405 408 409 410 429 500 501 502 503 504 server gateway unavailable found denied unauthorized unauthorised forbidden find
    request again occurred oops whoops uh wrong requested link page address permission access rights session expired sign log contact home back go reload report return
    ref ray incident vorgang trace correlation reference nginx apache openresty caddy varnish iis cloudfront traceback file line javascript script scripts cookies browser noscript
    enable activate turn allow checking human seconds moment update upgrade anwendung seite angeforderte website bitte dienst berechtigung zugriff interner startseite sitzung
    application site veuillez fichier avez êtes erreur introuvable trouvée refusé interdit indisponible accueil expiré aplicación página sitio activa active vuelva permiso archivo
    volver acceso interno servicio sesión blah bla asdf qwerty foo xxx test dummy placeholder sample filler example text content title description summary paragraph coming written
    construction replace untitled blank tbd tba todo fixme none heading subtitle item add write insert put enter describe diagram done announced determined completed""".split()
)
_ERROR_LINE = re.compile(r"[\w.]*(?:Error|Exception)\b|xxx|at [\w.$<>]+\(")
_VERSIONED = re.compile(r"\w/\d+\.\d|\bN/A\b", re.I)
_NAVIGATION = re.compile(r"^\s*(?:[^\n|·•>]{1,30}\s*[|·•»]\s*){2,}[^\n|·•]{1,30}\s*$", re.M)
_SEPARATOR = re.compile("[|·•»]")
_HEADING = re.compile(r"^[ \t]*#{1,6}\s[^\n]*$", re.M)
_DIGIT = re.compile(r"\d")
#: Digits, letters of hexadecimal numbers and blanks, which pages of one template do not share.
_VARIES = str.maketrans("", "", "0123456789abcdef \t\r\n")
_NUMBER = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+")


def _by_trigger(patterns: list[str]) -> dict[str, list[int]]:
    """For each trigger word the places of the patterns that hold it."""
    out: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        spelled = " ".join([p.replace("?", ""), re.sub(r"\w\?", "", p), p.replace("[sz]", "s").replace("?", ""), p.replace("[sz]", "z").replace("?", "")]).lower()
        for w in _TRIGGERS:
            if w in spelled:
                out.setdefault(w, []).append(i)
    return out


_WORDINGS = _PAGE + _FILLER
_COMPILED = [re.compile(p, re.I | re.M) for p in _WORDINGS]
_WITH = _by_trigger(_WORDINGS)
#: Wordings that lines of errors and versions may hold without any trigger word.
_UNTRIGGERED = [i for i, p in enumerate(_WORDINGS) if "traceback" in p or "exception" in p or "nginx" in p or "xxx" in p or "n/a" in p]


def prose(text: str) -> str:
    """The text without fenced and inline code."""
    return _INLINE.sub(" ` ", _FENCE.sub("\n", text))


def _read(m: re.Match) -> tuple[str, str] | None:
    """Notation and name of a mark; None if its signs do not belong together."""
    if m["blank"]:
        return "_", ""
    a, b = m["open"], m["close"]
    inner, outer = a.strip("=-!*"), b.lstrip("-*!=").removesuffix("s") if ")" in b else b.lstrip("-*!=")
    mirrored = inner[::-1].translate(_PAIRS)
    if not (mirrored == outer or mirrored.lstrip("#$%") == outer or mirrored.rstrip("#$%") == outer):
        return None
    return f"{a}a{b}", m["name"].strip()


def marks(text: str) -> list[tuple[str, str, str, bool, bool]]:
    """``(context, notation, name, known, discussed)`` of each mark in the prose of a text."""
    if not _LIKELY.search(text):
        return []
    out = []
    for sentence in _SENTENCE.split(prose(text)):
        found = list(_MARKS.finditer(sentence)) if _LIKELY.search(sentence) else None
        if not found:
            continue
        rest = _MARKS.sub(" ", sentence)
        quoted = [m.span() for m in _QUOTED.finditer(sentence)]
        code = len(_CODE.findall(rest)) > 1 + len(rest) // 120
        about = bool(_ABOUT.search(rest))
        plain = _MARKS.sub(" \x00 ", sentence)
        parts = [_WORD.findall(x.lower()) for x in plain.split("\x00")]
        for k, m in enumerate(found):
            got = _read(m)
            if got is None or code or any(a < m.start() and m.end() < b for a, b in quoted):
                continue
            notation, name = got
            known = notation in _KNOWN or bool(name) and not notation.startswith("_") and bool(_ASKS.search(name))
            out.append((f"{' '.join(parts[k][-2:])} _ {' '.join(parts[k + 1][:2])}", notation, name, known, about))
    return out


def _plain(x: str) -> str:
    """A sentence without what differs between pages of one template."""
    return _NUMBER.sub("0", x) if _DIGIT.search(x) else x


_judged: dict[str, tuple[int, int, list[str]]] = {}


def _judge(line: str, ws: list[str]) -> tuple[int, int, list[str]]:
    """Of a line or sentence: hits of page and filler wording, words they cover, the sentences left."""
    latin = len(_LATIN.intersection(ws)) and sum(w in _LATIN for w in ws)
    if latin >= 3 and latin >= 0.6 * len(ws):
        return 1, len(ws), []
    hits, covered, rest = 0, 0, line
    # page and filler wording holds no inline code
    if "`" not in line and "()" not in line:
        tried = {i for w in _TRIGGERS.intersection(ws) for i in _WITH.get(w, ())}
        if tried or _VERSIONED.search(line) or _ERROR_LINE.match(line.strip()):
            spans = []

            def take(m: re.Match) -> str:
                spans.append(len(_WORD.findall(m[0])))
                return "\n"

            for i in sorted(tried.union(_UNTRIGGERED)):
                rest = _COMPILED[i].sub(take, rest)
            hits, covered = len(spans), sum(spans)
    return hits, covered, [_plain(x.strip().lower()) for x in rest.split("\n") if _WORD.search(x)]


def page(text: str) -> tuple[int, int, int, list[str]]:
    """``(words, words in page or filler wording, hits of such wording, other sentences)`` of a text of any length, headings and navigation aside."""
    body = _NAVIGATION.sub("\n", text) if _SEPARATOR.search(text) else text
    bare = _HEADING.sub("\n", body)
    body = bare if bare.strip() else body.replace("#", " ")
    total = strong = covered = 0
    others: list[str] = []
    for line in _SENTENCE.split(body):
        ws = _WORD.findall(line.lower())
        if not ws:
            continue
        known = _judged.get(line) if len(line) < 200 else None
        if known is None:
            known = _judge(line, ws)
            if len(_judged) > 50_000:
                _judged.clear()
            _judged[line] = known
        total, strong, covered, others = total + len(ws), strong + known[0], covered + known[1], others + known[2]
    return total, covered, strong, others


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, t, text in zip(b["doc_id"], b["t"], b["text"]):
            for context, notation, name, known, about in dict.fromkeys(marks(text)):
                rows.append((doc, t, context, notation, name, known, about, *(None,) * 7))
            words, covered, strong, others = page(text)
            if not words:
                continue
            sizes: dict[int, int] = {}
            for o in others:
                h = xxhash.xxh3_64_intdigest(o) - (1 << 63)
                sizes[h] = sizes.get(h, 0) + len(_WORD.findall(o))
            family = min(sizes, default=0)
            whole = xxhash.xxh3_64_intdigest(text.lower().translate(_VARIES)) - (1 << 63)
            rows.append((doc, t, *(None,) * 5, family, whole, words, covered, strong, np.array(list(sizes), np.int64), np.array(list(sizes.values()), np.int32)))
        out = pd.DataFrame(rows, columns=["doc_id", "t", "context", "notation", "name", "known", "about", "family", "whole", "words", "covered", "strong", "sentences", "sizes"])
        yield out.astype({"known": "boolean", "about": "boolean", "family": "Int64", "whole": "Int64", "words": "Int32", "covered": "Int32", "strong": "Int32"})


_SCHEMA = "doc_id long, t long, context string, notation string, name string, known boolean, about boolean, family long, whole long, words int, covered int, strong int, sentences array<long>, sizes array<int>"


def _slots(scanned: DataFrame) -> DataFrame:
    """doc_id, kind, evidence: records with a mark left in a slot."""
    each = scanned.where("context IS NOT NULL").select("doc_id", "t", "context", F.xxhash64("context").alias("c"), "notation", "name", "known", "about")
    # what aligned records hold at the same place: distinct texts first, so copies do not count
    distinct = each.groupBy("c", "notation", "name").agg(F.min("t").alias("t"), F.count_distinct("t").alias("texts"))
    induced = distinct.groupBy("c").agg(F.count_distinct("notation").alias("notations"), F.count_distinct("name").alias("names"), F.sum("texts").alias("texts"))
    induced = cut(induced)
    slots = cut(each.join(broadcast_below(induced, induced.count(), 48), "c"))
    several = F.col("notations") >= F.when(F.size(F.split("context", r"\w+")) > 3, 2).otherwise(3)  # fewer words around it tell less
    marks_of = slots.groupBy("notation").agg(F.count_if(several & ~F.col("about")).alias("in_slots"), F.count_if(~F.col("about")).alias("marks"))
    placeholders = cut(marks_of.where(f"in_slots >= 2 AND in_slots >= {INDUCED} * marks").select("notation", F.lit(True).alias("induced")))
    judged = slots.join(broadcast_below(placeholders, placeholders.count(), 64), "notation", "left").withColumn("induced", F.coalesce("induced", F.lit(False)) & ~F.col("notation").isin(_SHARED))
    # one notation that keeps its single name, or its blank, over many texts was left unfilled in each of them
    kept = F.col("notation").isin(_RETAINED) & (F.col("names") == 1) & (F.col("texts") >= RECURS)
    filled = F.when(F.col("about"), F.col("notations") >= 3).otherwise(several | F.col("known") | F.col("induced") | kept)
    return judged.where(filled).groupBy("doc_id").agg(F.lit("slot").alias("kind"), F.min("context").alias("evidence"))


def _pages(scanned: DataFrame) -> DataFrame:
    """doc_id, kind, evidence: texts of which hardly a word is their own."""
    docs = scanned.where("words IS NOT NULL").select("doc_id", "t", "family", "whole", "words", "covered", "strong", "sentences", "sizes")
    texts = docs.drop("doc_id").groupBy("t").agg(*[F.first(c).alias(c) for c in ("family", "whole", "words", "covered", "strong", "sentences", "sizes")])
    texts = cut(texts)
    # texts that share their least sentence are versions of one another and count once
    held = texts.select("family", F.explode("sentences").alias("s")).distinct()
    furniture = cut(held.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS).select("s"))
    likely = texts.where("strong > 0")
    known = likely.select("t", F.explode(F.arrays_zip("sentences", "sizes")).alias("x")).select("t", F.col("x.sentences").alias("s"), F.col("x.sizes").alias("n"))
    known = known.join(broadcast_below(furniture, furniture.count(), 16), "s").groupBy("t").agg(F.sum("n").alias("recurring"))
    templates = texts.groupBy("whole").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS).select("whole", F.lit(True).alias("template"))
    judged = likely.select("t", "whole", "words", "covered").join(known, "t", "left").withColumn("left", F.col("words") - F.col("covered") - F.coalesce("recurring", F.lit(0)))
    empty = (F.col("left") <= 0.2 * F.col("words")) | ((F.col("left") <= 8) & (F.col("covered") >= 4) & (F.col("covered") * 2 >= F.col("left")))
    by_wording = judged.where(empty).select("t", F.concat(F.col("covered"), F.lit(" of "), F.col("words"), F.lit(" words")).alias("evidence"))
    by_template = texts.select("t", "whole").join(templates, "whole").select("t", F.lit("recurring page").alias("evidence"))
    gone = cut(by_wording.unionByName(by_template).groupBy("t").agg(F.min("evidence").alias("evidence")))
    return docs.select("doc_id", "t").join(broadcast_below(gone, gone.count(), 64), "t").groupBy("doc_id").agg(F.lit("page").alias("kind"), F.min("evidence").alias("evidence"))


def residue(documents: DataFrame) -> DataFrame:
    """doc_id, kind (slot or page), evidence: texts with unfilled slots, and texts that are pages without content.

    A mark counts if texts aligned by the words around it hold several notations, if
    its notation is one of placeholders (known, or induced from such slots) or its
    name asks to be replaced; one beside words about placeholders counts only where
    three notations meet; one in code or quotes never does.  A page is a text of any
    length of which, headings and navigation aside, nearly all words belong to page
    wording, filler or sentences recurring over at least ``RECURS`` otherwise
    different texts, or that recurs in so many texts with only numbers changed.  Null
    ids and null or blank texts give no rows; a text that recurs is judged once and
    named under each of its ids; an empty table gives no rows.
    """
    docs = documents.select("doc_id", F.xxhash64("text").alias("t"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    scanned = cut(docs.mapInPandas(_scan, _SCHEMA))
    return _slots(scanned).unionByName(_pages(scanned))


def found(documents: DataFrame) -> DataFrame:
    """doc_id."""
    return residue(documents).select("doc_id").distinct()


def real_texts(documents: DataFrame) -> DataFrame:
    """The documents without the ones found; all columns and repeated rows are kept."""
    return documents.join(found(documents), "doc_id", "left_anti")
