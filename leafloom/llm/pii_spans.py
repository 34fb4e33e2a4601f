"""Candidate spans of personal items and their features; fixed values first."""

from __future__ import annotations

import re

import ahocorasick

LABELS = ("private_email", "private_phone", "account_number", "private_address", "private_person")

# -- fixed values: wording --------------------------------------------------------------------------------------------
CUES = {
    "private_email": "e-mail email mail correo courriel posta e-posta mailto",
    "private_phone": "phone tel tel. tél tél. telefon téléphone teléfono telefone telefono mobile fax handy",
    "account_number": "ssn id n° nº no no. passport passeport pasaporte passaporte reisepass ausweisnr ausweisnr. ausweis steuer-id identité identità identidad dni nie nif cpf rg fiscale sociale tax iban account konto",
    "private_address": "address adresse anschrift dirección endereço indirizzo direccion",
    "private_person": "contact contacto contato contatto kontakt by von par por di name author autor auteur autore person speaker",
    "number": "number numbers numero número numéro nummer call whatsapp card carte karte tarjeta cartão carta",
    "other": "ref ref. lot sku isbn build version order item art. artikel batch day jour tag giorno dia día",
}
PARTICLES = "van von de di da del mac mc"
NO_NAMES = """
the a an by in on at of to for from with and or as it this that most more your our we you all any each every what when where while after before during since under near however surprisingly later next
der die das den dem des ein eine von im am zum zur bei mit nach vor seit aus auf und oder wie sie ihre jetzt alle
le la les un une des du de par en dans pour avec sur au aux après avant selon el los las una por al con sin según
o os as um uma do da no na nos nas em com sem il lo gli di del della un su
contact contacto contato contatto kontakt address adresse anschrift dirección endereço indirizzo phone email national passport id card account
street road lane avenue row way close drive square court hill place flat calle avenida rua travessa via viale vicolo tools works atelier app club plus gmbh ltd sl inc llc ag sa
""".split()
PLACES = "altmerrow castelvero duneford fenwick harrowfen lindmark merrowdale oberlind port-fenwick quellheim ribalta saltbrook vallune".split()
GIVEN = """
aldis anouk belo benno brisa calla corvin delphe dorian emrik farina fenja gaspar hedda ilsabe ismene jannik jorun kaelo kalette lorric ludo maren mirela nevio odalys orla pelle perrin quirin rhosyn
sanne selo silvan tavi thyra ulrike vasco veda velric wendel wilmot xanthe yolis ysolde zenka
""".split()
SURNAME_ENDS = "ander ardo berry castell dale eaux etti gard holt iski inger lund mark mere ova quen sson strup well wick".split()
GIVEN_ENDS = "a ara amo anne as eth ette eus ia ik im ine ina ir is o ora orn ric un une ur us wen ela enne elle oreus imo iel ias ian".split()

# -- pieces of patterns -----------------------------------------------------------------------------------------------
_U = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪİĶĻŁŃŅŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽ"
_L = "a-zß-öø-ÿāăąćčďđēęěğģīıķļłńņňōőœřśşšťūůűźżž"
_ESC = r"\\+u0[01][0-9a-fA-F]{2}"
_CAP = rf"(?:[{_U}]['’])?(?:[{_U}]|{_ESC})(?:[{_L}]|{_ESC})+(?:['’](?:[{_U}{_L}]|{_ESC})[{_L}]+)?"
_WORD = rf"(?:{_CAP}(?:-(?:(?:van|von|de|di|Mac) )?{_CAP})*|(?:[{_U}]|{_ESC})(?:[{_U}'’-]|{_ESC})+(?![{_L}])|(?:[{_U}]|{_ESC})\.(?:-?[{_U}]\.)?|(?:{'|'.join(PARTICLES.split())})(?= [{_U}\\]))"
_RUN = re.compile(rf"(?<![\w\\])(?:{_WORD})(?:(?: |, ){_WORD})+")
_TOKEN = re.compile(_WORD)
_TOWN = rf"[{_U}][\w'’]+(?:[- ][{_U}][\w'’]+)?"
_NAMED = rf"(?:[{_U}][\w'’]+ ){{1,3}}"
_STREET_EN = rf"{_NAMED}(?:Street|Road|Lane|Avenue|Row|Way|Close|Drive|Square|Court|Hill|Place|Terrace|Gardens)"
_STREET_DE = rf"(?:[{_U}]\w*(?:straße|strasse|weg|allee|gasse|platz|pfad|ring|ufer|damm|steig)|(?:Am|An der|Im|Zum|Zur|Auf dem|Auf der|Unter den)(?: [{_U}][\w'’]+){{1,2}})"
_STREET_RO = rf"(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Rua|Travessa|Praça|Largo|Estrada|Via|Viale|Vicolo|Piazza|Corso|Strada)(?: (?:de la|de los|de las|de|del|da|do|dos|das|della|delle|dello|dei|degli|di|dell['’]))?(?: ?[{_U}][\w'’]+){{1,3}}"
_STREET_FR = rf"(?:rue|impasse|chemin|avenue|allée|place|boulevard|quai|cours|passage|route|ruelle|sentier)(?: (?:de la |de l['’]|des |du |de |d['’])| )(?:[{_U}][\w'’-]+)(?: [{_U}][\w'’-]+)*"
_NB = r"(?<![\w.+/=-])"
_NA = r"(?![\w/=+]|[.,:-]\d)"
_TLD = r"(?:[\w-]+\.)+[A-Za-z]{2,}"

DETECTORS: list[tuple[str, str, re.Pattern[str]]] = [
    ("private_email", "at_sign", re.compile(rf"(?<![\w.+%/:@-])[\w][\w.+%'-]*[@＠]{_TLD}(?![\w@])")),
    ("private_email", "at_word", re.compile(rf"(?<![\w.+%-])[\w][\w.+%'-]* ?(?:\[at\]|\(at\)|\{{at\}}|<at>|\[@\]) ?[\w-]+(?: ?(?:\[dot\]|\(dot\)|\{{dot\}}|\[\.\]|\.) ?[\w-]+)+", re.I)),
    ("private_email", "at_plain", re.compile(r"(?<![\w.+%-])[\w][\w.+%'-]* at [\w-]+(?: dot [\w-]+)+(?!\w)")),
    ("private_phone", "plus", re.compile(rf"{_NB}\+\d{{1,3}}(?:[ .-]?\(\d{{1,4}}\))?(?:[ .-]?\d{{1,5}}){{2,6}}{_NA}")),
    ("private_phone", "bracket", re.compile(rf"{_NB}\(0?\d{{2,4}}\)[ -]?\d{{3}}[ -]\d{{3,4}}{_NA}")),
    ("private_phone", "slash", re.compile(rf"{_NB}0\d{{2,4}}/\d{{3}}(?: ?\d{{2}}){{1,3}}{_NA}")),
    ("private_phone", "pairs", re.compile(rf"{_NB}0\d(?:[ .]\d\d){{4}}{_NA}")),
    ("private_phone", "double_zero", re.compile(rf"{_NB}00\d{{2}}[- ]\d{{2,3}}[- ]\d{{5,8}}{_NA}")),
    ("private_phone", "dotted", re.compile(rf"{_NB}\d{{3}}\.\d{{3}}\.\d{{4}}{_NA}")),
    ("account_number", "iban", re.compile(rf"{_NB}[A-Z]{{2}}\d\d(?: ?[0-9A-Z]{{4}}){{3,7}}(?: ?[0-9A-Z]{{1,3}})?{_NA}")),
    ("account_number", "three_two_four", re.compile(rf"{_NB}\d{{3}}-\d\d-\d{{4}}{_NA}")),
    ("account_number", "two_threes", re.compile(rf"{_NB}\d\d \d{{3}} \d{{3}} \d{{3}}(?! \d){_NA}")),
    ("account_number", "dots_dash", re.compile(rf"{_NB}\d{{3}}\.\d{{3}}\.\d{{3}}-\d\d{_NA}")),
    ("account_number", "letter_digits", re.compile(rf"{_NB}[A-Z]\d{{7}}{_NA}")),
    ("account_number", "digits_letter", re.compile(rf"{_NB}\d{{8}}-[A-Z]{_NA}")),
    ("account_number", "tax_code", re.compile(rf"{_NB}[A-Z]{{6}}\d\d[A-Z]\d\d[A-Z]\d{{3}}[A-Z]{_NA}")),
    ("private_address", "number_first", re.compile(rf"{_NB}(?:(?:Flat|Apartment|Apt\.?|Unit) \d+\w?,? )?\d+[A-Za-z]? {_STREET_EN},? {_TOWN}(?:,? \d{{4,6}}(?!\d))?")),
    ("private_address", "number_first", re.compile(rf"{_NB}(?:(?:Flat|Apartment|Apt\.?|Unit) \d+\w?,? )?\d+[A-Za-z]? {_STREET_EN},? [{_U}][{_L}'’]+(?:[- ][{_U}][{_L}'’]+)?,? [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}(?!\w)")),
    ("private_address", "french", re.compile(rf"{_NB}\d+(?: ?[a-z]|(?: bis| ter))?,? {_STREET_FR}(?:,| -| –)? \d{{4,6}} {_TOWN}")),
    ("private_address", "street_first", re.compile(rf"(?<!\w)(?:{_STREET_DE}|{_STREET_RO}),? \d+ ?[a-z]?(?:,| -| –)? \d{{4,6}} {_TOWN}")),
]

_SURNAME = re.compile(rf"(?:{'|'.join(SURNAME_ENDS)})$")
_GIVEN_END = re.compile(rf"(?:{'|'.join(GIVEN_ENDS)})$")
_CUE_OF = {w: label for label, ws in CUES.items() for w in ws.split()}
#: Segments have at most so many words; the bound of the segments of the model.
MOST_WORDS = 8
#: Any run of digits with separators, a letter at most at either end; what it is, is up to shape and context.
_DIGIT_RUN = re.compile(rf"{_NB}(?:\+|\()?(?:[A-Z]{{1,2}})?\d+(?:[ .\-/()]{{1,2}}\d+)*[A-Z]?{_NA}")
_BEFORE = re.compile(r"[^\W\d_][\w°º.-]*|[.!?;|,\n{}\[\]]")
_DATE = re.compile(r"(?:19|20)\d\d-\d\d-\d\d|\d\d?[./]\d\d?[./](?:19|20)?\d\d")
_ABSTRACT = re.compile(
    r"(?:tion|sion|ment|ings?|ness|ity|ance|ence|ice|ices|ure|ures|age|ship|ory|ary|ies|isms?|ors|ers|al|ive|ful|ous|ual|able|ual|ette|um|ew|ews|our|ide|ard|ates?|ouncil|board|ungen?|heit|keit|schaft|ción|ções|ção|zione)$"
)
_GAPS = {",": "list", "and": "list", "or": "list", "&": "list", "und": "list", "oder": "list", "et": "list", "ou": "list", "y": "list", "o": "list", "e": "list", ";": "list", "–": "beside", "-": "beside", "|": "beside", "·": "beside", "(": "beside"}
_LEFT = re.compile(r"([^\W\d_][\w°º.-]*|n[°º])[^\w\n]{0,3}$", re.I)
_NO_NAMES, _PLACES, _GIVEN, _PARTICLES = map(frozenset, (NO_NAMES, PLACES, GIVEN, PARTICLES.split()))
_IMAGE = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|css|js)$", re.I)
_KEY = re.compile(r'\\?"([A-Za-z_ ]{1,30})\\?"\s*:\s*\[?\s*\\?"$')
_PERSON_KEYS = frozenset("person author autor auteur autore contact contacto kontakt speaker editor byline writer reporter owner employee customer".split())
_ENDS = re.compile(r"\s*(?:$|[·|,;:–—()\"<\n\\*\d]|\.(?:\s|$)|- )|\n")
_UNESCAPE = re.compile(r"\\+u([0-9a-fA-F]{4})")

Span = tuple[int, int, str, tuple[str, ...]]


def left_cue(text: str, start: int) -> str:
    m = _LEFT.search(text, max(0, start - 24), start)
    return _CUE_OF.get(m.group(1).casefold(), "none") if m else "start"


def near_cue(text: str, start: int) -> str:
    """The cue nearest before ``start`` among the last four words of its sentence or cell."""
    words = [m.group() for m in _BEFORE.finditer(text, max(0, start - 60), start)][-4:]
    for w in reversed(words):
        if not w[0].isalpha():
            break
        cue = _CUE_OF.get(w.casefold()) or _CUE_OF.get(w.casefold().rstrip("."))
        if not cue and w[-1] == ".":
            break
        if cue and cue != "private_person":
            return cue
    return "none"


#: Segments farther apart than this have no transition of their own.
NEAR = 16
_NAMED_GAP = re.compile(r"[,;|·–-]? ?([^\W\d_][\w.-]*):?")


def gap_of(text: str, end: int, start: int) -> str | None:
    """How two segments that follow each other are joined: as parts of a list, side by side, or not closely."""
    if not 0 < start - end <= NEAR:
        return None
    gap = text[end:start].strip()
    m = _NAMED_GAP.fullmatch(gap)
    return _GAPS.get(gap) or ("named" if m and _CUE_OF.get(m.group(1).casefold(), "other") not in ("other", "private_person") else None)


def transition(text: str, before: Span, after: Span) -> str | None:
    """The feature of two segments that follow each other closely: both labels and how they are joined."""
    gap = gap_of(text, before[1], after[0])
    return gap and f"next:{before[2]}>{after[2]}:{gap}"


def _check_digit(digits: str) -> bool:
    """The check of card numbers."""
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def number_spans(text: str, known: set[tuple[int, int]]) -> list[Span]:
    """Runs of digits that no detector has named, each as a phone and as an account number."""
    out: list[Span] = []
    for m in _DIGIT_RUN.finditer(text):
        start, end = m.span()
        digits = re.sub(r"\D", "", m.group())
        if not 7 <= len(digits) <= 19 or any(a < end and start < z for a, z in known):
            continue
        shape = ["date"] if _DATE.match(m.group()) else []
        if len(digits) >= 13 and _check_digit(digits):
            shape.append("checked")
        letters = any(c.isalpha() for c in m.group())
        for label in ("private_phone", "account_number"):
            feats = [f"any:{label}", f"any:{label}_near={near_cue(text, start)}", f"any:{label}_digits={'few' if len(digits) < 9 else 'phone' if len(digits) < 14 else 'many'}"]
            feats += [f"any:{label}_{x}" for x in (*shape, *(["letter"] if letters else []), *(["plus"] if m.group()[0] == "+" else []))]
            out.append((start, end, label, tuple(feats)))
    return out


def _kind(token: str) -> str:
    """given, surname, initial, particle, stop, place or word"""
    if token[-1] == ".":
        return "initial"
    t = _UNESCAPE.sub(lambda m: chr(int(m.group(1), 16)), token).casefold().replace("’", "'")
    if t in _PARTICLES and (token[0].islower() or token.isupper()):
        return "particle"
    parts = t.split("-")
    if t in _PLACES:
        return "place"
    if t in _NO_NAMES:
        return "stop"
    if t in _GIVEN:
        return "given"
    if len(parts) <= 2 and all(_SURNAME.search(p) and len(p) > 4 for p in parts):
        return "surname"
    if _GIVEN_END.search(t) and 3 <= len(t) <= 9 and len(parts) == 1:
        return "givenlike"
    return "word"


def person_spans(text: str, start: int = 0, stop: int | None = None) -> list[Span]:
    """Sub-spans of runs of capitalised words that might be names, with their features."""
    out: list[Span] = []
    for run in _RUN.finditer(text, start, len(text) if stop is None else stop):
        tokens = [(m.start(), m.end(), _kind(m.group())) for m in _TOKEN.finditer(text, run.start(), run.end())]
        listed = any(k in ("surname", "given") for _, _, k in tokens)
        n = len(tokens)
        commas = [text[tokens[i][1] : tokens[i + 1][0]] == ", " for i in range(n - 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + MOST_WORDS)):
                inner = commas[i:j]
                if sum(inner) > 1:
                    break
                kinds = [k for _, _, k in tokens[i : j + 1]]
                if "stop" in kinds:
                    break
                if kinds[0] == "particle" and not any(inner):
                    continue
                start, end = tokens[i][0], tokens[j][1]
                if not listed:
                    if kinds[-1] not in ("particle", "initial") or any(inner):
                        out.append((start, end, "private_person", _plain(text, start, end, kinds, inner, i == 0 and j == n - 1)))
                    continue
                feats = ["person", f"person_left={left_cue(text, start)}"]
                if any(inner):
                    c = inner.index(True)
                    feats.append("form=" + _shape(kinds[: c + 1]) + "," + _shape(kinds[c + 1 :]))
                else:
                    feats.append("form=" + _shape(kinds))
                if "place" in kinds:
                    feats.append("has_place")
                if text[start:end].isupper():
                    feats.append("upper")
                if kinds[-1] == "particle" or kinds[-1] == "initial" and not any(inner):
                    feats.append("open_end")
                if text[max(0, start - 2) : start].strip()[-1:].isdigit():
                    feats.append("digit_before")
                out.append((start, end, "private_person", tuple(feats)))
    return out


def _plain(text: str, start: int, end: int, kinds: list[str], inner: list[bool], whole: bool) -> tuple[str, ...]:
    """Features of a segment of a run in which no word is in a list of names or ends as one."""
    key = _KEY.search(text, max(0, start - 40), start)
    cue = left_cue(text, start)
    if key:
        last = re.split(r"[_ ]|(?<=[a-z])(?=[A-Z])", key.group(1))[-1].casefold()
        left = "key_person" if last in _PERSON_KEYS else "key_name" if last == "name" else "key"
    elif text[start - 1 : start] == "\n" or "|" in text[max(0, start - 3) : start]:  # a word of the line or cell before is no cue
        left = "start"
    elif cue == "private_person":
        m = _LEFT.search(text, max(0, start - 24), start)
        left = "byline" if ":" in text[m.end(1) : start] or m.group(1)[0].isupper() and not text[: m.start()].rstrip(" *_#>|-\t")[-1:].isalnum() else "cue"
    else:
        left = cue
    if left == "none" and _BEFORE.search(text, max(0, start - 14), start) and gap_of(text, start - len(_tail(text, start)), start):
        left = "joined"
    feats = ["plain", f"plain_left={left}", "plain_form=" + (_shape(kinds) if not any(inner) else "comma"), "plain_whole" if whole else "plain_part"]
    if not _ENDS.match(text, end):
        feats.append("plain_runs_on")
    words = [w.casefold() for w in re.findall(r"\w{3,}", text[start:end])]
    if left != "none" and any(re.search(rf"\b{w}\b", text) for w in words):
        feats.append("plain_common")
    if any(_ABSTRACT.search(w) for w in words):
        feats.append("plain_abstract")
    if left in ("cue", "joined", "none"):
        feats.append(f"plain_{left}_{'abstract' if any(_ABSTRACT.search(w) for w in words) else 'word'}{min(len(kinds), 4)}")
    if "place" in kinds:
        feats.append("plain_place")
    if text[start:end].isupper():
        feats.append("plain_upper")
    return tuple(feats)


def _tail(text: str, start: int) -> str:
    """The joint before ``start``: up to a blank, a conjunction or sign and a blank."""
    m = re.search(r"(?: (?:and|or|und|oder|et|ou|y|o|e|&) |, )$", text[max(0, start - 8) : start])
    return m.group() if m else ""


def _shape(kinds: list[str]) -> str:
    """Which kinds a part of a name is made of: G given, g given-like, I initial, p particle, S surname, w other."""
    code = {"given": "G", "givenlike": "g", "initial": "I", "particle": "p", "surname": "S", "place": "P", "word": "w"}
    s = "".join(code[k] for k in kinds)
    s = re.sub("I+", "I", s)
    return s if len(s) <= 3 else s[:1] + "*" + s[-1]


STREET_WORDS = """
Street Road Lane Avenue Row Way Close Drive Square Court Hill Place Terrace Gardens
straße strasse weg allee gasse platz pfad ring ufer damm steig Am An Im Zum Zur Auf Unter
rue impasse chemin avenue place boulevard quai cours passage route ruelle sentier
Calle Avenida Plaza Paseo Camino Ronda Rua Travessa Praça Largo Estrada Via Viale Vicolo Piazza Corso Strada
""".split()
def _gate() -> ahocorasick.Automaton:
    """Words that give away an address, in one automaton."""
    a = ahocorasick.Automaton()
    for w in STREET_WORDS:
        a.add_word(w, ("A", len(w), w[0].isupper()))
    a.make_automaton()
    return a


_GATE = _gate()
_NUMBER = re.compile(r"[+(]?(?:[A-Z]{1,6})?\d[\dA-Z ().\-/]{5,}[\dA-Z]")


def _windows(text: str) -> dict[str, list[list[int]]]:
    """Stretches of the text in which addresses and numbers can lie."""
    out: dict[str, list[list[int]]] = {"A": [], "N": []}
    n = len(text)
    for end, (tag, size, whole) in _GATE.iter(text):
        end += 1
        if end < n and (text[end].isalpha() if tag == "A" else text[end].islower()):
            continue
        if whole and end > size and text[end - size - 1].isalpha() and text[end - size - 1] != "n":
            continue
        w = out[tag]
        if w and w[-1][1] >= end:
            continue
        lo, hi = text.rfind("\n", 0, end) + 1, text.find("\n", end)
        w.append([lo, n if hi < 0 else hi])
    for m in _NUMBER.finditer(text):
        out["N"].append([max(0, m.start() - 2), min(n, m.end() + 2)])
    return out


_WHERE = {"private_phone": "N", "account_number": "N", "private_address": "A"}


def candidates(text: str) -> list[Span]:
    """All candidate segments of a text: (start, end, label, features)."""
    out: set[Span] = set()
    at = "@" in text or "＠" in text
    word_at = any(x in text for x in ("at]", "(at", "(AT", "[AT", " dot ", "<at", "{at", "[@"))
    where = _windows(text)
    whole = [[0, len(text)]]
    for label, name, pattern in DETECTORS:
        if label == "private_email" and not (at if name == "at_sign" else word_at):
            continue
        for lo, hi in where[_WHERE[label]] if label in _WHERE else whole:
            for m in pattern.finditer(text, lo, hi):
                start, end = m.span()
                feats = [f"{label}:{name}", f"{label}_left={left_cue(text, start)}"]
                if label == "private_email" and _IMAGE.search(m.group()):
                    feats.append("image")
                if label == "private_address":
                    feats.append("postcode" if re.search(r"\d{4,6}", m.group()) else "no_postcode")
                out.add((start, end, label, tuple(feats)))
    out.update(number_spans(text, {s[:2] for s in out}))
    out.update(person_spans(text))
    return list(out)
