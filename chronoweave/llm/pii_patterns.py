"""What personal information can look like in one text: candidates of every kind with their form, the term before them and what is known of it.

Whether a candidate discloses a person is decided elsewhere, from statistics of the whole corpus. Nothing here looks at a window of so many characters:
what goes before a place is matched backwards from it (the flag (?r)), what follows forwards, each as far as its form reaches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import regex

# ---- fixed values: words and forms that mark the kinds -------------------------------------------------------------
FILE_ENDINGS = "bmp bz2 c cc class cpp css csv dll exe gif go gz h hpp htm html ico jar java jpeg jpg js json jsx lock log lua md mjs mp3 mp4 o pdf php png py rb rs sh so sql svg tar tgz toml ts tsx txt wasm webp woff xml yaml yml zip".split()
PLACEHOLDER_LOCALS = "user username you yourname your.name name email someone somebody nobody foo bar xxx".split()
ID_LABELS = [
    r"ssn", r"social security(?: (?:no\.?|number|nr\.?))?", r"soc\. ?sec\. (?:no\.?|number)", r"tax id", r"taxpayer (?:number|id|no\.?)", r"tin", r"steuer-?id(?:-?nr\.?)?", r"steuernummer", r"dni(?: titular)?", r"documento", r"nif", r"nie",
    r"cpf(?: (?:no\.?|number))?", r"aadhaar(?: (?:no\.?|number|id))?", r"nhs (?:no\.?|number)", r"pesel", r"bsn", r"codice fiscale",
    r"national id(?: (?:no\.?|number))?", r"national insurance(?: (?:no\.?|number))?", r"ni (?:no\.?|number)", r"nino", r"personal number", r"personnummer", r"passport(?: (?:no\.?|number|nr\.?))?", r"reisepass(?:-?(?:nr\.?|nummer))?",
]
ID_VALUES = [r"\d{3}(?P<ssn>[- ])\d{2}(?P=ssn)\d{4}", r"\d{9}", r"\d{2} \d{3} \d{3} \d{3}", r"\d{11}", r"\d{2}\.\d{3}\.\d{3}-?[A-Z]", r"\d{8}-?[A-Z]", r"(?:\d{2})?\d{6}[-+]\d{4}", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", r"[A-Z]{1,2}\d{7}", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"\d{4} \d{4} \d{4}", r"\d{3} \d{3} \d{4}"]
PHONE_LABELS = ["tel", "tel.", "telephone", "telefon", "telefono", "teléfono", "téléphone", "phone", "phone number", "mobile", "mobil", "cell", "fax", "handy", "móvil", "portable", "whatsapp"]
THING_LABELS = ["isbn", "sku", "invoice", "part no", "part no.", "order", "order number", "build", "rev", "epoch", "version", "serial", "ticket", "id", "port", "range", "tax id", "ssn"]
OPEN_PHONE_FORMS = [r"\d{10}", r"0\d[ -]\d{4}[ -]\d{4}", r"\(0\d\) ?\d{4}[ -]?\d{4}", r"\d{3,4}[ -]\d{3}[ -]?\d{3,4}"]  # tell nothing by themselves
PHONE_FORMS = [
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,5}",
    r"00 ?[1-9]\d{0,2}[ -]?\(0\)[ -]?\d{2,5}(?:[ -]\d{2,6}){1,3}",
    r"(?:1[-. ])?\([2-9]\d{2}\) ?\d{3}[-. ]\d{4}",
    r"(?:1[-. ])?[2-9]\d{2}([-. ])\d{3}\1\d{4}",
    r"0[1-9]\d{3} \d{6}", r"0[1-9]\d \d{4} \d{4}", r"0[1-9]\d{2} \d{3} \d{4}", r"0[1-9](?: \d{2}){4}",
]
EN_STREETS = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Crescent Cres Way Terrace Ter Place Pl Close Square Sq Row Boulevard Blvd Hill Parade Walk Mews Gardens Grove".split()
DE_ENDINGS = "straße strasse str. allee weg pfad platz gasse ring damm ufer steig chaussee stieg".split()
DE_BEGINNINGS = ["Am", "An der", "An den", "Auf dem", "Auf der", "Im", "In der", "Zum", "Zur", "Unter den", "Hinter der"]
FR_STREETS = ["rue", "avenue", "av.", "bd", "boulevard", "impasse", "place", "allée", "chemin", "quai", "cours", "route", "passage", "square"]
IT_STREETS = ["Via", "via", "Viale", "viale", "Piazza", "piazza", "Corso", "corso", "Largo", "Vicolo", "vicolo"]
PL_STREETS = ["ul.", "Ul.", "al.", "Al.", "pl.", "Pl."]
ES_STREETS = ["Calle", "C/", "Avda.", "Avenida", "Av.", "Plaza", "Paseo", "Pza.", "Camino", "Ronda", "Travesía", "Carrera"]
# For text all in capitals or all in lower case: other languages' street words that are no everyday words ("hashring 9", "STRING 5"),
# English ones that are, so that in lower case no word may follow them, and words that are in no street's name.
ONE_CASE = {"de": ["straße", "strasse", "str.", "allee", "gasse", "chaussee", "weg"], "fr": ["rue", "boulevard", "impasse", "allée", "chemin", "quai"], "es": ["calle", "c/", "avda."]}
EN_OPEN = "st ave dr ct court cres way ter place pl close square sq row hill parade walk gardens grove drive".split()
NO_STREETS = "a an the this that these those it its of in on at to by per for from with and or not is are was be as no any each every more most other such same different new only hours? minutes? min days? weeks? months? years? seconds? sec ms miles? km m gb mb kb tb bytes? bits? lines? items? rows? columns? people times? percent".split()
PARTICLES = ["von der", "von", "van der", "van den", "van", "de la", "de los", "de", "del", "della", "di", "da", "dos", "du", "ter", "ten", "zu", "zum", "bin", "ibn", "al", "el", "le", "la"]
FIRM_ENDINGS = "Ltd Inc LLC GmbH AG Corp Co Systems Project Contributors Authors Group Foundation Team Labs".split()
NAME_CUES = r"(?:[Aa]uthor|AUTHOR|[Mm]aintainer|[Cc]ontact|[Oo]wner|[Nn]ame|[Hh]older|by|[Bb]y|to|à|a|from|of|ask|ping|week|Ansprechpartner)"

# ---- e-mail ---------------------------------------------------------------------------------------------------------
_AT = re.compile(r"@| ?\[@\] ?| ?\(@\) ?")
_AT_ANY = re.compile(r" ?(?:\([Aa][Tt]\)|\[[Aa][Tt]\]|<[Aa][Tt]>|\{[Aa][Tt]\}|\[@\]|\(@\)) ?|@|&#64;|&#x40;|&commat;|%40| at-sign | AT | at (?=[\w-]{2,40} ?(?:dot |DOT |\(dot\)|\[dot\]))")
_AT_SIGNS = ["&#64;", "&#x40;", "&commat;", "%40", " at-sign ", " AT ", "(at)", "[at]", "<at>", "{at}", "(AT)", "[AT]", "<AT>", "[@]", "(@)", " at "]
_LOCAL = regex.compile(r"(?r)[^\W_](?:[\w.+%-]*[\w+])?")
_DOT = r"(?:\.| ?(?:\([Dd][Oo][Tt]\)|\[[Dd][Oo][Tt]\]|\{dot\}|\[\.\]) ?| (?:dot|DOT) )"
_DOMAIN = re.compile(rf"[^\W_](?:[\w-]{{0,61}}[^\W_])?(?:{_DOT}[^\W_](?:[\w-]{{0,61}}[^\W_])?)+")
_LAST = re.compile(r"([^\W\d_]{2,})\Z")
_BEFORE_LOCAL = regex.compile(r"(?r)[^\s\"'<>()\[\]{},;]*")


class Candidate(NamedTuple):
    """start, end, kind, form, cue (the term right before it) and told: 1 beside a label of its kind, -1 of things, else 0. sure: a form that tells by itself."""

    start: int
    end: int
    kind: str
    form: str
    cue: str | None
    told: int
    sure: bool


_CUE = regex.compile(r"(?r)(?P<w>[^\W\d_]{2,})[.]?['\"]?[ :=#'\"(\[-]*")


def cue(t: str, at: int) -> str | None:
    """The word before a place, with nothing but signs between."""
    m = _CUE.match(t, 0, at)
    return m["w"].lower() if m and m.end() == at else None


def emails(t: str) -> Iterator[Candidate]:
    if not any(x in t for x in _AT_SIGNS):
        if "@" not in t:
            return
        at = _AT
    else:
        at = _AT_ANY
    for m in at.finditer(t):
        local = _LOCAL.match(t, 0, m.start())
        domain = local and _DOMAIN.match(t, m.end())
        if not domain:
            continue
        last = _LAST.search(domain[0])
        if not last or last[1].lower() in FILE_ENDINGS or local[0].lower() in PLACEHOLDER_LOCALS:
            continue
        before = _BEFORE_LOCAL.match(t, 0, local.start())[0]
        if "://" in before or before.endswith(("@", "$")) or t[max(0, local.start() - 2) : local.start()] in ("${", "<%"):
            continue  # credentials in a URL
        after = t[domain.end() : domain.end() + 2]
        if m[0] == "@" and (local[0] in ("git", "hg", "svn") and after[:1] in (":", "/") or re.match(r":[\w~/]", after) or before.lower().endswith("ssh://")):
            continue  # location of a repository
        yield Candidate(local.start(), domain.end(), "email", "plain" if m[0] == "@" else "disguised", cue(t, local.start()), 0, True)


# ---- phone, identity number -----------------------------------------------------------------------------------------
_NUMBER = re.compile(r"(?<![\w.,+/:#-])(?:[A-Z]{1,2} ?)?[+(]?\d(?:[\d ().+-]{4,}\d)(?:-?[A-Z]\b| [A-D]\b)?")
_AFTER_PHONE = r"(?![\w%]|[.,:-]\d)"
_PHONE = re.compile("(?:" + "|".join(f"(?P<f{i}>{p})" for i, p in enumerate(PHONE_FORMS)).replace(r"\1", r"(?P=sep)").replace("([-. ])", "(?P<sep>[-. ])") + ")" + _AFTER_PHONE)
_OPEN_PHONE = re.compile("(?:" + "|".join(f"(?P<f{i}>{p})" for i, p in enumerate(OPEN_PHONE_FORMS)) + ")" + _AFTER_PHONE)
_labels = lambda xs: "|".join(re.escape(x) for x in sorted(xs, key=len, reverse=True))
_THING = regex.compile(r"(?r)(?i)(?<![A-Za-z_])(?:" + _labels(THING_LABELS) + r")[ :#=\"']*")
_PHONE_LABEL = regex.compile(r"(?r)(?i)(?<![^\W_])(?:" + _labels(PHONE_LABELS) + r")(?:['\"]|\.| (?:no\.?|number|nr\.?))?(?: ?[:=#] ?| is | )?[ '\"]{0,2}")
_VALUE = re.compile("(?:" + "|".join(f"(?P<v{i}>{p})" for i, p in enumerate(ID_VALUES)) + r")(?![\w]|-\d|\.\d)")
_LABEL = regex.compile(r"(?r)(?i)(?<![^\W_])(?:" + "|".join(ID_LABELS) + r")(?![^\W_])(?:['\"]| of (?:the|a|our|my) \w+(?: \w+)?)?(?: ?[:=#] ?| is | )?[ '\"]{0,2}")


def _before(p: regex.Pattern, t: str, at: int) -> bool:
    return p.match(t, 0, at) is not None


def numbers(t: str) -> Iterator[Candidate]:
    """Numbers that could be identity numbers or phones; a number of no such form comes out as kind number, for what it tells of its cue."""
    for m in _NUMBER.finditer(t):
        at = m.start()
        value, name = _VALUE.match(t, at), cue(t, at)
        if value and _before(_LABEL, t, at):
            yield Candidate(at, value.end(), "id_number", next(k for k, v in value.groupdict().items() if v and k != "ssn"), name, 1, False)
            continue
        start = at
        if t[at].isalpha():
            at += 1 + (not t[at + 1].isdigit() and t[at + 1] not in "+(") + (t[at + 1] != " " and t[at + 2] == " ")
        fits = lambda x: x and 9 <= sum(map(str.isdigit, x[0])) <= 16
        phone = _PHONE.match(t, at)
        sure = fits(phone)
        if not sure:
            phone = _OPEN_PHONE.match(t, at)
        if sure or fits(phone):
            told = -1 if _before(_THING, t, at) else 1 if _before(_PHONE_LABEL, t, at) else 0
            yield Candidate(at, phone.end(), "phone", ("sure " if sure else "open ") + next(k for k, v in phone.groupdict().items() if v and k != "sep"), name, told, bool(sure))
        elif value:
            yield Candidate(start, value.end(), "id_number", next(k for k, v in value.groupdict().items() if v and k != "ssn"), name, -1 if _before(_THING, t, start) else 0, False)
        else:
            yield Candidate(start, m.end(), "number", "other", name, 0, False)


# ---- address --------------------------------------------------------------------------------------------------------
_CAP = r"[A-ZÀ-ÖØ-ÞŁŠŽ][\w’'-]*"
_SP = r"(?: |\s*\n[ \t]*(?://|#|\*|--)?[ \t]*)"
_TAIL = rf"(?:,? (?:Apt|Suite|Unit|Flat|No|Floor)\.? ?\w{{1,4}}| ?#\d{{1,4}})?(?:,?{_SP}(?:\d{{5}} )?{_CAP}(?: {_CAP}){{0,2}}(?:, [A-Z]{{2}})?(?: \d{{5}})?)?"
_EN = rf"\d{{1,4}}[A-Za-z]? (?:{_CAP}\.? ){{1,4}}?(?:{'|'.join(EN_STREETS)})(?!\w|['’]\w)\.?" + _TAIL
_DE = rf"(?:(?:{'|'.join(DE_BEGINNINGS)}) (?:{_CAP} ?){{1,3}}|(?:{_CAP} )?[A-ZÄÖÜ][\wäöüß-]*?(?:{'|'.join(re.escape(x) for x in DE_ENDINGS)})|(?:{_CAP}[ -])?(?:Straße|Allee|Weg|Platz)) ?\d{{1,4}} ?[a-z]?(?![\w])" + _TAIL
_FR = rf"\d{{1,4}}(?: ?(?:bis|ter))?,? (?:{'|'.join(re.escape(x) for x in FR_STREETS)}) (?:de la |de l['’]|des |du |de |d['’])?(?:{_CAP}[ -]?){{1,3}}" + _TAIL
_ES = rf"(?:{'|'.join(re.escape(x) for x in ES_STREETS)}) ?(?:del |de las |de los |de la |de )?(?:{_CAP} ){{1,3}},? ?(?:n[.º°]+ ?)?\d{{1,4}}(?!\w)" + _TAIL
_IT = rf"(?:{'|'.join(re.escape(x) for x in IT_STREETS)}) (?:della |delle |dei |del |di |d['’])?(?:{_CAP} ){{1,3}}?\d{{1,4}}(?!\w)" + _TAIL
_PL = rf"(?:{'|'.join(re.escape(x) for x in PL_STREETS)}) (?:{_CAP} ){{1,3}}?\d{{1,4}}(?:/\d{{1,4}})?(?!\w)" + _TAIL
_HINTS = {
    _EN: [f" {x}" for x in EN_STREETS], _FR: [f" {x} " for x in FR_STREETS], _ES: [f"{x} " for x in ES_STREETS],
    _DE: [f"{x} " for x in DE_ENDINGS + DE_BEGINNINGS] + ["Straße", "Allee ", "Weg ", "Platz "],
}
_HINTED = [(re.compile("|".join(map(re.escape, hints))), re.compile(rf"(?<![\w.,:/@#$-])(?:{p})")) for p, hints in _HINTS.items()]


class _Words:
    """Hints that are words of their own before a capital, found as plain text: quicker than one pattern of them all."""

    def __init__(self, words: list[str]) -> None:
        self.words = [w + " " for w in words]

    def finditer(self, t: str) -> Iterator[_Words.Hint]:
        found = []
        for w in self.words:
            at = t.find(w)
            while at >= 0:
                if t[at + len(w) : at + len(w) + 1].isupper() and not t[at - 1 : at].isalnum():
                    found.append((at, at + len(w)))
                at = t.find(w, at + 1)
        return (self.Hint(*x) for x in sorted(found))

    class Hint(NamedTuple):
        a: int
        b: int

        def start(self) -> int:
            return self.a

        def end(self) -> int:
            return self.b


_NEW_HINTS = [(_Words(xs), re.compile(rf"(?<![\w.,:/@#$-])(?:{p})")) for p, xs in ((_PL, PL_STREETS), (_IT, IT_STREETS))]


class _AtNumbers:
    """Hints that begin with a house number: the numbers of a text are looked for once, whatever number of patterns begins with them."""

    _house = re.compile(r"\d(?<![\w.,:/@#$-]\d)\d{0,3}[A-Za-z]?(?: ?(?:bis|ter|BIS|TER))?,? (?=[^\W\d_])")
    _last: tuple[str, list[int]] = ("", [])

    def __init__(self, pattern: str) -> None:
        self.pattern = re.compile(pattern)

    def finditer(self, t: str) -> Iterator[re.Match]:
        if _AtNumbers._last[0] is not t:
            _AtNumbers._last = (t, [m.start() for m in self._house.finditer(t)])
        done = 0
        for at in _AtNumbers._last[1]:
            if at >= done and (m := self.pattern.match(t, at)):
                done = m.end()
                yield m


def _one_case(case: Callable[[str], str]) -> Iterator[tuple[re.Pattern, re.Pattern]]:
    """Hints and patterns like the above for text of one case. A town in a line of its own needs a state or a postcode."""
    lower = case("A") == "a"
    c = "a-zà-öø-ÿßłšž" if lower else "A-ZÀ-ÖØ-ÞŁŠŽ"
    some = lambda xs: "(?:" + "|".join(re.escape(case(x)) for x in xs) + ")"
    word = (rf"(?!(?:{'|'.join(NO_STREETS)})(?!\w))" if lower else "") + rf"[{c}](?:[{c}ß’'-]*[{c}ß])?(?!\w)"
    last = r"(?! ?\w)" if lower else rf"(?! ?[{c}])"
    town, state, code = rf"{word}(?: {word}){{0,2}}", rf", [{c[:3]}]{{2}}(?!\w)", r" \d{5}(?!\w)"
    unit = rf"(?:,? {some(['Apt', 'Suite', 'Unit', 'Flat', 'No', 'Floor'])}\.? ?\w{{1,4}}(?!\w)| ?#\d{{1,4}}(?!\w))?"
    tail = rf"{unit}(?:,?{_SP}(?:\d{{5}} (?:{town}{last}|{word})|{town}(?:{state}(?:{code})?|{code}))|, {town}{last})?"
    number = r"\d(?<![\w.,:/@#$-]\d)\d{0,3}"  # a digit first is quick to look for
    hard = [x for x in EN_STREETS if not lower or x.lower() not in EN_OPEN]
    en = rf"{number}[A-Za-z]? (?:{word}\.? ){{1,4}}(?:{some(hard)}|{some(EN_STREETS)}(?!\.? ?{word}))(?!\w|['’]\w)\.?"
    fr = rf"{number}(?: ?{some(['bis', 'ter'])})?,? {some(ONE_CASE['fr'])} (?:{some(['de la', 'des', 'du', 'de'])} |{some(['de l', 'd'])}['’])?(?:{word}(?:[ -]{word}){{0,2}}{last}|{word})"
    de_end, es_begin = some(ONE_CASE["de"]), some(ONE_CASE["es"])
    de = rf"(?<![\w.,:/@#$-])[{c}][{c}-]{{2,}}?{de_end} ?\d{{1,4}} ?[A-Za-z]?(?!\w)"
    es = rf"(?<![\w.,:/@#$-]){es_begin} (?:{some(['del', 'de las', 'de los', 'de la', 'de'])} )?{word}(?: {word}){{0,2}},? ?(?:{case('n')}[.º°]+ ?)?\d{{1,4}}(?!\w)"
    for hint, p in ((_AtNumbers(en), en), (_AtNumbers(fr), fr), (re.compile(rf"{de_end} ?\d"), de), (re.compile(rf"{es_begin} "), es)):
        yield hint, re.compile(p + tail)


_FORMS = ["en", "fr", "es", "de", *(f"{c} {x}" for c in ("upper", "lower") for x in ("en", "fr", "de", "es")), "pl", "it"]
_HINTED += [*_one_case(str.upper), *_one_case(str.lower), *_NEW_HINTS]
_WORDS_BACK = regex.compile(r"(?r)(?:[^\s]+ ){0,7}[^\s]*")  # as many words as any form has before its street word
_WORDS_ON = re.compile(r"\S*(?:\s+\S+){0,8}")  # and after it
_ADDRESS_LABEL = regex.compile(r"(?r)(?i)(?:address|anschrift|adresse|dirección|domicilio|indirizzo|adres|lives at|wohnhaft|residente in|abita in)(?: in)?['\"]?[ :=]*['\"]?")
_OPEN_STREETS = {"it"}


def addresses(t: str) -> Iterator[Candidate]:
    """Only the surroundings of words that mark a street are searched. Italian streets are open ("via Port 80") unless a postcode and town follow."""
    for form, (hint, pattern) in zip(_FORMS, _HINTED):
        done = 0
        for h in hint.finditer(t):
            if h.start() < done:
                continue
            at = max(done, _WORDS_BACK.match(t, 0, h.start()).start(), t.rfind("\n", 0, h.start()) + 1)
            m = pattern.search(t, at, _WORDS_ON.match(t, h.end()).end())
            if m and m.start() <= h.end():
                m = pattern.match(t, m.start())  # as far as it goes
                told = 1 if _before(_ADDRESS_LABEL, t, m.start()) else 0
                yield Candidate(*m.span(), "address", form, cue(t, m.start()), told, form not in _OPEN_STREETS or bool(re.search(r"\d{5} \w", m[0])))
                done = m.end()


# ---- names ----------------------------------------------------------------------------------------------------------
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĘĚĞİŁŃŇŐŘŚŠŞŢŤŮŰŹŻŽ"
_BEFORE = r"(?<![\w.@+&/$%<\\-])(?<!\w['’])"
_PARTS = "|".join(sorted(PARTICLES, key=len, reverse=True))
_PART = rf"(?:(?:{_PARTS}|{_PARTS.upper()}) )"
_STUCK = r"(?:[Aa]l-|AL-)?(?:Mc|MC|[OoDd]['’](?=\w\w))?"
_END = r"(?![\w@’]|['’]\w\w|[.+_-]\w|&#|%40)"
_INITIALS = rf"(?:[{_UP}]\.? ){{0,2}}"
_FORWARD = re.compile(rf"{_BEFORE}(?P<a>[{_UP}](?:\.|[^\W\d_]+(?:-[{_UP}][^\W\d_]+)?)) (?={_INITIALS}{_PART}{{0,2}}{_STUCK}(?P<b>[{_UP}][^\W\d_]{{2,}})(?P<c>(?:-[{_UP}][^\W\d_]{{2,}})*){_END})")
_LOWER_FAMILY = rf"(?:[a-z]\.? ){{0,2}}(?:(?:{_PARTS}) ){{0,2}}(?:al-)?(?:mc|[od]['’](?=\w\w))?(?P<b>[^\W\d_]{{3,}})(?P<c>(?:-[^\W\d_]{{3,}})*){_END}"
_LOWER = re.compile(rf"(?P<a>[^\W\d_A-Z]{{2,}}|[a-z]\.) (?={_LOWER_FAMILY})")
_LOWER_CUE = re.compile(r"(?:uthor|aintainer|-by):? +(?=[^\W\d_A-Z])")
_LINE_HEAD = re.compile(r"(?:[-*|#/] ?)*")
_COMMA = re.compile(rf", (?=(?P<a>[{_UP}](?:\.|[^\W\d_]+))(?: [{_UP}]\.)?(?![\w@’'-]|[.+_]\w))")
_FAMILY = rf"{_PART}{{0,2}}{_STUCK}(?P<b>[{_UP}][^\W\d_]{{2,}})(?:-[{_UP}][^\W\d_]{{2,}})*"
_FAMILY_BACK, _FAMILY_ON = regex.compile(rf"(?r){_BEFORE}{_FAMILY}"), re.compile(_FAMILY)
_FIRM = re.compile(rf" (?:{'|'.join(FIRM_ENDINGS)})\b|, (?:Ltd|Inc)\b")


class Lexicon:
    def __init__(self, given: list[str], family: list[str]) -> None:
        self.given, self.family = {x.lower() for x in given}, {x.lower() for x in family}


def names(t: str, seen: set[str], lex: Lexicon, mails: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str, str]]:
    """Candidates: start, end, given part, family part (lower case), form (forward or back). seen: the words of t."""
    for m in _FORWARD.finditer(t):
        if not _FIRM.match(t, m.end("c")):
            yield m.start(), m.end("c"), m["a"].lower(), m["b"].lower(), "forward"
    for m in _COMMA.finditer(t):
        if t[m.start() - 1 : m.start()].isalpha():
            f = _FAMILY_BACK.match(t, 0, m.start())
            f = f and _FAMILY_ON.fullmatch(t, f.start(), m.start())  # forwards, so that a prefix (Mc, O') isn't taken for the name's own letters
            if f:
                yield f.start(), m.end("a"), m["a"].lower(), f["b"].lower(), "back"
    starts = set()
    for g in seen & lex.given:
        at = t.find(g + " ")
        while at >= 0:
            if not at or not (t[at - 1].isalnum() or t[at - 1] in "_.@+&/$%<\\-" or t[at - 1] in "'’" and t[at - 2 : at - 1].isalnum()):
                starts.add(at)
            at = t.find(g + " ", at + 1)
    starts |= {m.end() for m in _LOWER_CUE.finditer(t)}
    starts |= {_LINE_HEAD.match(t, t.rfind("\n", 0, a) + 1).end() for a, _ in mails}
    for at in starts:
        m = _LOWER.match(t, at)
        if m:
            yield m.start(), m.end("c"), m["a"], m["b"].lower(), "forward"


_WORD = re.compile(r"(?<![\w.@+'’-])[^\W\d_]{3,}(?![\w@+])")


def words(t: str) -> list[str]:
    """The words whose corpus counts tell how common a term is outside names."""
    return _WORD.findall(t)
