"""Template residue and error-page text, by a multi-pattern automaton.

One pass of an Aho-Corasick automaton over the folded words of a text finds all known phrases; a second
automaton over the raw text finds where slots may open, and each such place is checked exactly.

* **Slots**: an unfilled slot in any of the notations below, or the text of a missing value where a value
  belongs. One is enough. Tags of tokenizers, JSON, list brackets, percentages and slots that a sentence
  merely names ("a tag such as {name}") are none.
* **Filler**: a filler phrase, or four or more filler words in a row. One is enough.
* **Errors and demands**: phrases of error pages and of demands for scripts, cookies or a browser check. A
  text is excluded when these phrases cover at least half of its words, menus and footers left aside, so
  that real content which mentions an error, or adds a notice, stays.

Long phrases are matched by any three words in a row, so that a misspelt word hides only its
neighbourhood; short texts are read again with slips of one letter mended. Whole texts are read. Null, empty and blank texts show no residue.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERED = 0.5
SHORT = 24  # texts of so many words beside menus and footers are read again with their spelling mended
NAME_WORDS = 4  # so many words and no more beside an error with a code, path or address are the name of the business
NGRAM = 3

# Phrases of error pages, in the languages of the corpus.
ERRORS = """
just a moment | checking your browser before you continue | this may take # seconds | verify that you are human by completing the action below
sinusuri ang iyong browser bago magpatuloy | your request was blocked | estamos comprobando que usted es una persona | habilite las cookies
security check your browser is being verified | please wait we are checking your connection | hold on redirecting you | one moment solve the puzzle to prove you are a person
please enable javascript to view this page | you need to turn on javascript in your browser to run this app | javascript is disabled
follow the steps for your browser then reload | your browser is not supported | switch to a newer one to see our content
this website requires scripts and cookies | your browser has them switched off | kailangan ng javascript para makita ang pahinang ito | paki on ito sa iyong browser
we're sorry but this storefront doesn't work properly without javascript enabled | palihog i on ang javascript aron makita kini nga panid
active javascript en su navegador para ver este sitio | loading | if nothing happens scripts may be blocked
internal server error | bad gateway | service unavailable | gateway timeout | not found | page not found | forbidden | access denied | server error | gateway problem | too many visitors
something went wrong | this page does not exist | we can't find that page | temporarily offline for maintenance | connection timed out | account suspended | session expired
bandwidth limit exceeded | error # | oops | host error | the site is down for maintenance | please check back later | retry in # minutes | our team has been told
an unexpected error occurred while building this page | the upstream server gave no valid answer | the server met a condition it could not handle
fatal uncaught exception in / on line # | warning mysql connect failed in / line # | error establishing a database connection
the service can't take your request right now retry after # seconds | please contact the administrator and give the time of the failure
you don't have permission to open / on this server | the page you were looking for has moved or never existed | try going back to the start page
the address / was not found on this server | the requested url was removed or its name was changed | sorry nothing lives here anymore
if you own this site please contact your hosting provider | contact billing to restore the page | please log in again and reload the page
hindi nahanap ang pahina | paumanhin tinanggal na ang pahinang hinahanap mo | bumalik sa unang pahina | pansamantalang hindi magamit ang site
subukan muli mamaya | may ginagawang pagsasaayos | wala makit i ang panid | ang / wala na dinhi | wala sa server na ito ang / | balik sa unang panid
página no encontrada | lo sentimos la página que busca ya no está disponible | error interno del servidor | se produjo un error inesperado | vuelva a intentarlo más tarde
request id # | incident # | ray # | server at @ port #
you're being rate limited | you have been rate limited | rate limit exceeded | too many requests | request timeout | request could not be processed | this site can't be reached
we're having trouble loading this page | the page isn't working | the page you requested could not be found | the requested resource is not available | this content is unavailable
die seite wurde nicht gefunden | seite nicht gefunden | interner serverfehler | ein fehler ist aufgetreten | zugriff verweigert | bitte aktivieren sie javascript | bitte versuchen sie es später erneut
page introuvable | cette page n'existe pas | erreur interne du serveur | une erreur est survenue | une erreur s'est produite | accès refusé | veuillez activer javascript | veuillez réessayer plus tard
acceso denegado | la página no existe | página não encontrada | erro interno do servidor | acesso negado | pagina non trovata | errore interno del server | pagina niet gevonden
"""

# The parts of a demand for scripts. A demand is any of: HEAD VERB THING TAIL; this PLACE FAILS without THING; THING STATE, VERB it TAIL.
THING = "javascript | java script | js | js and cookies | scripting | scripts | client side scripts | cookies"
HEAD = "please | kindly | you must | sorry you need to | in order to proceed"
VERB = "enable | allow | activate | turn on | switch on | unblock"
TAIL = (
    "to continue | to use this site | to view our store | to see the content | for the app to start | so we know you're not a robot | before this page can load | "
    "or the menu will not appear | and refresh | to proceed"
)
PLACE = "page | menu | shop | application | site | store | storefront | website"
FAILS = "does not work | cannot run | will not render | stays blank | will not load"
STATE = "is required | are required | must be active | seems to be blocked | seem to be blocked | appears to be off | appear to be off | is disabled | are disabled"

# What surrounds content on a page and counts neither way.
AROUND = """
home about services contact | home about us our team blog | privacy terms sitemap | skip to content | menu | search this site | back to home | all rights reserved
follow us | home branches
"""

# Filler that is in place of content wherever it stands.
FILLER = """
sample text goes here | this is placeholder copy | type your description here | replace it with your own words | palitan ang tekstong ito
double click me to add your own story | edit or delete it then start writing | i'm a paragraph | this is your very first post | just another site
test test test asdf asdf qwerty | content to follow | blah blah blah | dito ilalagay ang paglalarawan ng negosyo | describe your business in one sentence
texto de ejemplo | short description of the item | item one item two | item two item three | your tagline here | headline goes here | add a subtitle here | button text
"""

# The words of classical filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua felis odio lectus nec "
    "ligula semper mauris faucibus cursus quam porta arcu nisl vitae blandit justo vestibulum tortor praesent "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
LATIN_RUN = 4

_NAME = r"[A-Za-z][\w .\-]*"
# What follows null and undefined as ordinary words, and what precedes them.
_TERM = r"\s+(?:and void|pointers?|values?|behaviou?rs?|hypothes[ie]s|sets?|variables?|references?|checks?|terms?|fields?|columns?|results?|strings?|ones?)\b"
_SPOKEN = re.compile(r"\b(?:is|was|be|been|are|were|not|as|or|and|use|uses|used|the|any|declared|returns?|returned|equals?|remains?|left|with|renders?|rendered)\s+[\"'`]?$", re.I)
# What opens a slot, and the form it must then have.
SLOTS = [
    ("{{", r"\{\{\{?\s*[#/^&>!$@]?[A-Za-z][^{}\n]*\}\}"), ("{%", r"\{%-?\s*[A-Za-z][^{}\n]*%\}"), ("<%", r"<%[=-]?\s*[@$]?[A-Za-z][^%\n]*%>"), ("<?", rf"<\?=?\s*\$?{_NAME}\s*\?>"),
    ("<<", rf"<<{_NAME}>>"), ("&lt;", rf"&lt;{_NAME}&gt;"), ("${", rf"\$\{{{_NAME}\}}"), ("$[", rf"\$\[{_NAME}\]"), ("{", r"\{([a-z][A-Za-z0-9_. ]+|[A-Z][A-Z0-9]*_[A-Z0-9_]+|\d)\}"), ("[[", rf"\[\[{_NAME}\]\]"),
    ("[", r"\[([A-Z][A-Z0-9]*(_[A-Z0-9]+)+|Your [A-Z][a-z]+( [A-Z][a-z]+)*|[Ii]nsert [a-z ]{2,}|object Object|(Business Name|Opening Hours|First Name|Address|Service|Email|Phone|Price|Owner|Branch|City|Year|Name))\]"),
    ("«", r"«(Business Name|Opening Hours|First Name|Address|Service|Email|Phone|Price|Owner|Branch|City|Year|Name)»"), ("@@", r"@@[a-z_]{2,}@@"),
    ("%", r"(?<![\w%])%{1,2}[A-Z][A-Z_]{2,}%{1,2}"), ("#", r"#[A-Z][A-Z_]{2,}#"), ("__", r"__[A-Z][A-Z_]+__"), ("|*", r"\|\*[A-Z_]{2,}\*\|"), ("*|", r"\*\|[A-Z][A-Z0-9_:]*\|\*"),
    ("<", r"<[a-z][a-z ]+ goes here>"), ("(insert", r"\(insert [a-z ]{2,}\)"), ("YOUR ", r"YOUR [A-Z ]{2,} HERE\b"), ("TODO:", r"TODO: ?[a-z]{3,}"), ("XXXXX", r"(?<![\w/+])XXXXX+(?![\w/+=])"),
    ("null", rf"(?<![\w.])null(?!\w)(?!{_TERM})"), ("undefined", rf"(?<![\w.])undefined(?!\w)(?!{_TERM})"), ("NaN", r"(?<![\w/+])NaN(?![\w/+=])"),
]
_MENTION = re.compile(r"(such as|like|called|e\.g\.|named|tag|spelled|written)\s+[\"'“‘]?$", re.I)
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
# Menus, breadcrumbs, footers and handles by their form.
_FRAME = re.compile(r"(?i)©\s*\d{4}[^.\n]*\.?(\s*All rights reserved\.?)?|[^\W\d]+ › \S+ › ((San|Santo|Santa|Puerto|New|Upper) )?\S+|Follow us: @\w+|\S+( [|·] \S+)+")
_MARK = re.compile("[©›|·@]")
_PIECE = re.compile(r"[\w-]+\.(?:example|com|net|org|ph)\b|\S*/\S*|[^\W_]+(?:'[^\W_]+)*")
_HEX = re.compile(r"(?=.*\d)[0-9a-f]{5,}|\d+")


def clean(text: str) -> str:
    """The text with plain spaces and apostrophes and without invisible characters."""
    text = re.sub("[​-‏‪-‮⁠﻿­]", "", text)
    return re.sub("[‘’]", "'", re.sub("[  -  　]", " ", text))


def words(text: str) -> list[str]:
    """Folded words; numbers and hexadecimal ids are #, paths are /."""
    text = unicodedata.normalize("NFC", text).casefold()
    out = []
    for w in _PIECE.findall(text):
        if "." in w and "/" not in w:
            out.append("@")
        elif "/" in w:
            # a path; but words that a slash joins stay words
            out.append("/") if w[0] in "/(" or _HEX.search(w) else out.extend(_WORD.findall(w))
        else:
            out.append("#" if _HEX.fullmatch(w) else w)
    return out


def demands() -> str:
    """All demands for scripts, spelt out from their parts."""
    parts = {k: [x.strip() for x in v.split("|")] for k, v in (("h", HEAD), ("v", VERB), ("t", THING), ("e", TAIL), ("p", PLACE), ("f", FAILS), ("s", STATE))}
    out = [f"{v} {t} {e}" for v in parts["v"] for t in (*parts["t"], "it") for e in parts["e"]]
    out += [f"{h} {v} {t}" for h in parts["h"] for v in parts["v"] for t in parts["t"]]
    out += [f"this {p} {f} without {t}" for p in parts["p"] for f in parts["f"] for t in parts["t"]]
    out += [f"{t} {s}" for t in parts["t"] for s in parts["s"]]
    return " | ".join(out)


def _phrases(block: str, whole: bool) -> Iterator[tuple[str, int]]:
    for phrase in re.split(r"[|\n]", block):
        p = phrase.split()
        if not p:
            continue
        if whole or len(p) <= NGRAM:
            yield " ".join(p), len(p)
        else:
            for k in range(len(p) - NGRAM + 1):
                yield " ".join(p[k : k + NGRAM]), NGRAM


@lru_cache(maxsize=1)
def automata():
    """The automaton over words with each pattern's kind, and the one over slot openers."""
    import ahocorasick

    a = ahocorasick.Automaton()
    # Words that filler shares with ordinary text ("goes here") only count in whole phrases or four in a row.
    for kind, block in (("around", AROUND), ("error", ERRORS), ("error", demands()), ("filler", FILLER)):
        for p, n in _phrases(block, whole=kind != "error"):
            a.add_word(f" {p} ", (kind, n, len(p)))
    for phrase in re.split(r"[|\n]", FILLER):
        p = phrase.split()
        for k in range(len(p) - 3):
            a.add_word(" " + " ".join(p[k : k + 4]) + " ", ("filler", 4, len(" ".join(p[k : k + 4]))))
    a.make_automaton()
    s = ahocorasick.Automaton()
    for k, (opener, form) in enumerate(SLOTS):
        s.add_word(opener, (len(opener), re.compile(form)))
    s.make_automaton()
    return a, s


@lru_cache(maxsize=1)
def _vocabulary() -> frozenset[str]:
    """The letters of all words of error phrases, in order, so that letters may be swapped."""
    return frozenset("".join(sorted(w)) for block in (ERRORS, demands()) for w in re.split(r"[|\s]+", block))


@lru_cache(maxsize=1)
def _spellings() -> tuple[set[str], dict[str, str]]:
    """The words of error phrases, and their forms with one letter left out."""
    vocabulary = {w for block in (ERRORS, demands()) for w in re.split(r"[|\s]+", block) if len(w) >= 5}
    return vocabulary, {w[:i] + w[i + 1 :]: w for w in sorted(vocabulary) for i in range(len(w))}


def respelt(w: list[str]) -> list[str]:
    """The words with slips of one letter in words of error phrases mended."""
    vocabulary, cut = _spellings()
    out = []
    for x in w:
        if x not in vocabulary and 4 <= len(x) <= 20:
            forms = [x] + [x[:i] + x[i + 1 :] for i in range(len(x))]
            x = next((f for f in forms[1:] if f in vocabulary), None) or next((cut[f] for f in forms if f in cut), x)
        out.append(x)
    return out


def has_slot(text: str) -> bool:
    _, slots = automata()
    for end, (n, form) in slots.iter(text):
        start = end - n + 1
        if (start and text[start - 1] == text[start] and text[start] in "{[<%" and n == 1) or not form.match(text, start):
            continue
        before = text[max(0, start - 20) : start]
        if not _MENTION.search(before) and not (text[start] in "nu" and _SPOKEN.search(before)):
            return True
    return False


def _match(w: list[str]) -> tuple[list[str], bool]:
    """What each word belongs to ('error', 'around' or ''), and whether filler was met."""
    line = " " + " ".join(w) + " "
    at = {}
    pos = 1
    for i, x in enumerate(w):
        at[pos - 1] = i
        pos += len(x) + 1
    phrases, _ = automata()
    kind = ["" for _ in w]
    filler = False
    for end, (k, n, size) in phrases.iter(line):
        first = at[end - size - 1]
        if k == "filler":
            filler = True
        else:
            for i in range(first, first + n):
                if kind[i] != "error":
                    kind[i] = k
    return kind, filler


def _share(w: list[str], kind: list[str]) -> float:
    """The share of error text; numbers beside it belong to it, and beside a number, path or host so do a few words of a name.

    A short text without any of these ("Not Found Cafe, San Juan") is judged by its words alone.
    """
    covered = kind.count("error")
    open_ = sum(1 for k, x in zip(kind, w) if not k and x not in "#/@")
    signed = any(x in ("#", "/", "@") for x in w) or covered >= NGRAM
    if open_ <= NAME_WORDS:  # what is left of a phrase around a slip belongs to it too
        open_ = 0 if signed else sum(1 for k, x in zip(kind, w) if not k and x not in "#/@" and "".join(sorted(x)) not in _vocabulary())
    return covered / (covered + open_) if covered else 0.0


def judge(text: str | None) -> tuple[bool, bool, float]:
    """(an unfilled slot, filler, share of words that are error text) of one text."""
    if not text or not text.strip():
        return False, False, 0.0
    text = clean(text)
    w = words(_FRAME.sub("\n", text) if _MARK.search(text) else text)
    kind, filler = _match(w)
    share = _share(w, kind)
    if share < COVERED and sum(k != "around" for k in kind) <= SHORT:
        mended = respelt(w)
        if mended != w:
            share = max(share, _share(mended, _match(mended)[0]))
    run = 0
    for x in w:
        run = run + 1 if x in LATIN else 0
        filler = filler or run >= LATIN_RUN
    return has_slot(text), filler, share


def judge_column(text: Column) -> Column:
    @F.pandas_udf("slot boolean, filler boolean, coverage double")
    def go(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([judge(x) for x in s], columns=["slot", "filler", "coverage"])

    return go(text)


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text", covered: float = COVERED) -> DataFrame:
    """``key``, ``slot``, ``filler``, ``coverage``, ``excluded`` of every row; other columns are dropped."""
    j = documents.select(F.col(key), judge_column(F.col(text)).alias("j")).select(key, "j.*")
    return j.withColumn("excluded", F.col("slot") | F.col("filler") | (F.col("coverage") >= covered))
