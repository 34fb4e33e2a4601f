"""Training of the span model: invented sentences with marked items, and exact semi-CRF gradients.

``python -m leafloom.llm.pii_train`` writes ``pii_weights.py``. The sentences are drawn from the grammar below; names and
numbers are put together at random. No table is read.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import defaultdict
from pathlib import Path

from leafloom.llm import pii_spans as S

#: A make-up of names with a weight between this and 0 is left out; unknown ones count so much.
S_UNSEEN = -1.5
_MARK = re.compile(r"<(\w+)\|([^|]*)\|>")
_ROOTS_S = "Ask Bell Brenn Crow Dun Ever Fal Grim Hal Hart Iver Jar Kess Lund Mar Mor Nor Old Pell Quist Rav Sten Tarn Thorn Ulver Ven Wex Yar Zell Øst Łyn Ñar".split()
_ROOTS_G = "Wyn Bel Tor Cad Far Gwen Kal Lor Mav Nim Pri Ras Sel Ist Elv Dor Jor Zor Vel Al".split()
_STREETS = ("Mill Road", "Quarry Street", "Heron Lane", "Old Mill Avenue", "Larch Row")
_WORDS = "table report office season notes summary link list page timetable".split()


def _given(r: random.Random) -> str:
    return r.choice(S.GIVEN).title() if r.random() < 0.6 else r.choice(_ROOTS_G) + r.choice(S.GIVEN_ENDS)


def _surname(r: random.Random) -> str:
    s = r.choice(_ROOTS_S) + r.choice(S.SURNAME_ENDS)
    x = r.random()
    if x < 0.06:
        return s + "-" + r.choice(("", "", "van ", "von ", "Mac ")) + r.choice(_ROOTS_S) + r.choice(S.SURNAME_ENDS)
    if x < 0.1:
        return "O'" + s
    return r.choice(("van ", "von ", "de ", "Mac ")) + s if x < 0.15 else s


def _person(r: random.Random) -> str:
    g, s, x = _given(r), _surname(r), r.random()
    if x < 0.03:
        p = f"{r.choice(('van', 'von', 'de'))} {r.choice(_ROOTS_S)}{r.choice(S.SURNAME_ENDS)}, {g}"
    elif x < 0.2:
        p = f"{s}, {g}"
    elif x < 0.32:
        p = f"{g} {r.choice('ABCDEFGHJKLMNPRSTUVY')}. {s}"
    elif x < 0.42:
        p = f"{g[0]}. {s}"
    else:
        p = f"{g} {s}"
    return p.upper() if x > 0.95 else p


def _d(r: random.Random, mask: str) -> str:
    return "".join(str(r.randrange(10)) if c == "#" else r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") if c == "?" else c for c in mask)


def _email(r: random.Random) -> str:
    local = r.choice(("{g}.{s}", "{s}_{g}", "{g}-{s}", "{g}+x1", "{g}{n}")).format(g=_given(r).lower(), s=_surname(r).split()[-1].lower(), n=r.randrange(99))
    host, tld = r.choice(("mintlo", "fjorley", "baskmail")), r.choice(("example", "test", "invalid"))
    return local.replace("'", "") + r.choice((f"@{host}.{tld}", f"＠{host}.{tld}", f" [at] {host} [dot] {tld}", f" (at) {host}.{tld}"))


_PHONES = ("+## ## 555 ####", "(555) 01#-####", "030/555 ## ##", "06 55 5# ## ##", "+55 (11) 9555-####", "0049-30-555####", "555.01#.####", "+33 9 99 ## ## ##", "+1 555 01# ####")
_ACCOUNTS = ("XX## #### #### #### ##", "9##-##-####", "00 ### ### ###", "000.###.###-##", "X#######", "000#####-?", "ZZZ?ZZ##A##Z###?")
_OTHERS = ("Ref. ####-##-####", "lot 00######", "SKU ###.###.###", "ISBN 978-9-9999-####-#", "build 10.4.##.#", "##/##/202# 1#:00", "54.#####, 9.#####", "version ##.##", "logo@2x.png", "@mint_lo", "order ###-##-#", "day ###")
_FIRMS = ("Morrow Tools", "Atelier Norrin", "Sastrería Luma SL", "Bluefen Works", "Halden & Quay Ltd", "Cobalt Heron GmbH", "Granite Mark Ltd", "Atelier Holt")


def _address(r: random.Random) -> str:
    n, t, c = r.randrange(1, 250), r.choice(S.PLACES).title(), _d(r, "99###")
    return r.choice((
        f"{n} {r.choice(_STREETS)}, {t} {c}", f"{n}B {r.choice(_STREETS)}, {t}, {c}", f"Flat {r.randrange(9)}, {n} {r.choice(_STREETS)}, {t}",
        f"Gerberweg {n}, {c} {t}", f"Kranichallee, {n} - {c} {t}", f"Am Alten Wehr {n}, {c} {t}", f"Rua do Salgueiro {n}c, {c} {t}", f"Via del Salice, {n} - {c} {t}",
        f"{n}, chemin des Hérons, {c} {t}", f"Calle Garza {n}, {c} {t}",
    ))


def sentence(r: random.Random) -> str:
    """A text with its items marked ``<label|text|>``."""
    p = lambda: f"<private_person|{_person(r)}|>"
    e = lambda: f"<private_email|{_email(r)}|>"
    t = lambda: f"<private_phone|{_d(r, r.choice(_PHONES))}|>"
    a = lambda: f"<account_number|{_d(r, r.choice(_ACCOUNTS))}|>"
    h = lambda: f"<private_address|{_address(r)}|>"
    o = lambda: _d(r, r.choice(_OTHERS))
    place = lambda: r.choice(S.PLACES).title()
    w = lambda: r.choice(_WORDS)
    return r.choice((
        lambda: f"{r.choice(('Contact', 'Contato', 'Kontakt'))}: {p()}, {r.choice(('phone', 'tel.', 'tél.'))} {t()}, e-mail {e()}",
        lambda: f"{r.choice(('By', 'Von', 'Par', 'Por', 'Di'))} {p()} · 2025-0{r.randrange(1, 9)}-11",
        lambda: f"{r.choice(('By', 'Par', 'Por'))} {p()}, {p()} · 2025-03-12",
        lambda: f"{p()} – {r.choice(('SSN', 'national ID', 'DNI', 'Steuer-ID', 'passport no.', 'RG'))} {a()}. The {w()} of {place()} lists the {w()}.",
        lambda: f"{r.choice(('National id', 'Passport no.', 'Cpf', 'Ssn'))}: {a()}; {e()}.",
        lambda: f"| {p()} | {h()} | {t()} |",
        lambda: f"Give me the {w()} ({r.choice((p, e, t, a, h))()})",
        lambda: f"Give me the {w()} ({p()}, {r.choice((p, e, t, a, h))()})",
        lambda: f"Give me the {w()} ({r.choice((o, o, lambda: r.choice(_FIRMS)))()})",
        lambda: f"The {w()} shows the {w()}. {o()}.",
        lambda: f"{r.choice(_FIRMS)} – {place()}, {place()}",
        lambda: f"{place()}, {h()}",
        lambda: f"{r.choice(('Address', 'Anschrift', 'Adresse'))}: {h()}",
        lambda: f'"contact": {{"person": "{p()}", "email": "{e()}", "phone": "{t()}"}}',
        lambda: f'"speakers": [{{"name": "{p()}"}}], "venue": {{"name": "{place()}", "address": "{h()}"}}, "company": {{"name": "{r.choice(_FIRMS)}"}}',
        lambda: f"Der Lieferhinweis von {place()} zeigt den Kartenverkauf. Das Hafenamt nennt die Werkstatt am Tag {o()}.",
        lambda: f"Die {r.choice(('zweite Spalte', 'Reparaturanleitung', 'Redaktion', 'Werkstatt'))} von {r.choice(_ROOTS_S)}{r.choice(('wick', 'bach', 'stad', 'mark'))} trennt die {r.choice(('Tiefkühlware', 'Wartezeiten'))}.",
        lambda: f"The parser of {r.choice(_ROOTS_S)}{r.choice(('wick', 'bach', 'stad', 'mark'))} shows the {w()}. La copie de {r.choice(_ROOTS_S)}wick Énumère le texte, comme à {r.choice(_ROOTS_S)}wick.",
        lambda: "YOU MAY ALSO LIKE",
        lambda: f"{place()}-{place()}, {r.choice(_FIRMS)}",
    ))()


_SYLLABLES = "ja ko wal ski du pont smi th ga ru mi ya ota ro be nak ash pri kum li wei cho hen ri que sa ba tos pe rez fi li po mü ller schu ber kov ack".split()
_HEADS = "Annual Harbour Quarterly Garden Service Customer Support Report Review Editorial Office Press Team Summer Winter Festival Guide Market Museum Library Music Travel Science Programme Notes Update News Collection Overview Board Council".split()


_COMMON = [h for h in _HEADS if S._ABSTRACT.search(h.lower())]
_MORE_PHONES = ("###-555-####", "555 ### ####", "555#######", "0#### ######", "+1 ### ### ####", "(0##) ### ####", "555-####", "0###/#######", "+49 ### #######")
_MORE_ACCOUNTS = ("#########", "########?", "##########", "### ### ###", "####-####-####", "?########", "############")
_DATES = ("20##-0#-1#", "1#.0#.20##", "20##/1#/0#", "##/##/20##", "##.#####")
_MORE_OTHERS = ("20##-0#-1#", "1#.0#.20##", "#######", "########", "### ### ###", "##.#####", "###-###-####", "1#,###,###", "20##/0#/1# 1#:##", "##-##-##-##", "#.###.###")


def _card(r: random.Random) -> str:
    """A card number whose check digit is right, sometimes wrong and then no item."""
    body = [r.randrange(10) for _ in range(15)]
    ok = next(d for d in range(10) if S._check_digit("".join(map(str, [*body, d]))))
    last = ok if r.random() < 0.7 else (ok + r.randrange(1, 10)) % 10
    t = "".join(map(str, [*body, last]))
    t = " ".join(t[i : i + 4] for i in range(0, 16, 4)) if r.random() < 0.7 else t
    return f"<account_number|{t}|>" if last == ok else t


def _isbn(r: random.Random) -> str:
    return next(t for t in iter(lambda: _d(r, "978-9-9999-####-#"), "") if S._check_digit(t.replace("-", "")))


def _word(r: random.Random) -> str:
    while True:
        w = "".join(r.choice(_SYLLABLES) for _ in range(r.choice((2, 2, 3)))).title()
        if S._kind(w) in ("word", "givenlike"):
            return w


def plain_name(r: random.Random) -> str:
    """A name of which no word is in a list or ends as a listed one does."""
    x, g, f = r.random(), _word(r), _word(r)
    return f"{g} {r.choice('ABCDEFGHJKLMNPRST')}. {f}" if x < 0.15 else f"{g[0]}. {f}" if x < 0.25 else f"{g} {_word(r)} {f}" if x < 0.3 else f"{g} {f}"


def plain_sentence(r: random.Random) -> str:
    """As ``sentence``, with names outside the lists, and with headings, titles and firms that are no names."""
    p = lambda: f"<private_person|{plain_name(r)}|>"
    h = lambda: " ".join(r.sample(_HEADS, r.choice((2, 2, 3))))
    w = lambda: r.choice(_WORDS)
    x = lambda: r.choice((h, h, lambda: plain_name(r)))()  # noqa: E731, may look like a name where none is meant
    c = lambda: " ".join(r.sample(_COMMON, r.choice((2, 2, 3))))  # noqa: E731, words that no name has
    cue = lambda: r.choice(("contact", "by", "par", "von", "por", "kontakt", "written by", "please contact", "author"))
    join = lambda: r.choice((" and ", " or ", ", ", " und ", " et ", " y "))
    phone = lambda: f"<private_phone|{_d(r, r.choice(_MORE_PHONES))}|>"
    account = lambda: f"<account_number|{_d(r, r.choice(_MORE_ACCOUNTS))}|>"
    return r.choice((
        lambda: f"Please {r.choice(('contact', 'Contact'))} {p()}",
        lambda: f"{r.choice(('by', 'contact', 'par', 'von', 'por'))} {p()}{join()}{p()}",
        lambda: f"The {w()} {cue()} {p()} shows the {w()}.",
        lambda: f"the {w()} {cue()} {p()}{join()}{p()} is new",
        lambda: f"The {w()} {cue()} {c()} shows the {w()} by {c()}.",
        lambda: f"{r.choice(('my number is', 'call', 'Phone:', 'phone', 'tel.', 'Telefon', 'you can call me at', 'WhatsApp'))} {phone()}",
        lambda: f"{r.choice(('Passport', 'passport no.', 'DNI', 'SSN', 'ID', 'Ausweis', 'IBAN', 'konto', 'Account', 'account no.', 'CPF', 'tax'))} {account()}",
        lambda: f"{p()}, {r.choice(('phone', 'tel.', 'Telefon'))} {phone()}, {r.choice(('passport', 'ID', 'account'))} {account()}",
        lambda: _card(r),
        lambda: f"{r.choice(('ISBN', 'order', 'lot', 'SKU', 'version'))} {_MARK.sub(lambda m: m[2], _card(r))}",
        lambda: f"The {w()}. ISBN {_isbn(r)}.",
        lambda: f"The {r.choice(('mobile', 'phone', 'fax', 'account', 'id', 'passport'))} {r.choice(('list', 'office of', 'price', 'page from', 'shop'))} {_d(r, r.choice(_DATES))} shows the {w()}.",
        lambda: f'"phone": null, "published": "{_d(r, r.choice(_DATES))}", "{w()}": "{_d(r, r.choice(_MORE_OTHERS))}"',
        lambda: f"{w()}\n{x()}\n{x()}\n{w()}\n\n{x()}",
        lambda: f"{x()} | {x()} | {w()}\n{w()} · {x()} · {w()}",
        lambda: f"{r.choice(('Contact', 'Kontakt', 'Contato'))}\n{x()}\n{w()}",
        lambda: f"{h()}, {h()}{join()}{c()}",
        lambda: f"{c()}, {c()}",
        lambda: f"the {w()} of {h()}{join()}{h()} shows the {w()}",
        lambda: f"WE KEEP {w().upper()}. {h().upper()} {w().upper()}. {h().upper()}, {w().upper()} {h().upper()}",
        lambda: f"The {w()} of {_d(r, r.choice(_MORE_OTHERS))} shows the {w()}.",
        lambda: f"{r.choice(('Ref.', 'order', 'ISBN', 'lot', 'SKU', 'version', 'price', 'day', 'total', 'at'))} {_d(r, r.choice((*_MORE_PHONES, *_MORE_OTHERS)))}",
        lambda: f"The {w()} has number {_d(r, r.choice(_MORE_OTHERS))}.",
        lambda: f"{r.choice(('By', 'Von', 'Par', 'Por', 'Di'))} {p()} · 2025-0{r.randrange(1, 9)}-11",
        lambda: f"{r.choice(('Contact', 'Contato', 'Kontakt', 'Author'))}: {p()}, {r.choice(('phone', 'tel.'))} <private_phone|{_d(r, r.choice(_PHONES))}|>",
        lambda: f'"{r.choice(("author", "person", "contact", "speaker"))}": "{p()}", "{r.choice(("title", "company", "venue", "headline"))}": "{x()}"',
        lambda: f'"name": "{x()}", "title": "{x()}"',
        lambda: f"# {h()}\n\nThe {w()} of {x()} shows the {w()} by {c()} and the {r.choice(_HEADS).lower()}.",
        lambda: f"{h()} | {h()} | {x()}",
        lambda: f"Contact: {(t := r.sample(_HEADS, 2))[0]} {t[1]}. The {t[0].lower()} is open.",
        lambda: f"In {x()} wird der Text von {c()} gezeigt.",
        lambda: f"{x()}",
    ))()


def parse(marked: str) -> tuple[str, set[tuple[int, int, str]]]:
    text, gold, at = "", set(), 0
    for m in _MARK.finditer(marked):
        text += marked[at : m.start()]
        gold.add((len(text), len(text) + len(m.group(2)), m.group(1)))
        text += m.group(2)
        at = m.end()
    return text + marked[at:], gold


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    m = max(a, b)
    return m if m == -math.inf else m + math.log1p(math.exp(min(a, b) - m))


def gradient(text: str, spans: list[S.Span], gold: set[tuple[int, int, str]], weights: dict[str, float]) -> tuple[float, dict[str, float]]:
    """Log-likelihood of the gold segments among the candidates and its gradient: forward and backward sums over all choices."""
    spans = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    sc = [sum(weights.get(f, 0.0) for f in s[3]) for s in spans]
    ends, n = [s[1] for s in spans], len(spans)
    before: list[list[tuple[int, str | None]]] = []  # near predecessors with their transition
    alpha: list[float] = []
    upto = [0.0]  # over the choices that end with one of the first spans, or none
    for i, s in enumerate(spans):
        far, near = bisect.bisect_right(ends, s[0] - S.NEAR - 1), bisect.bisect_right(ends, s[0], 0, i)
        before.append([(j, S.transition(text, spans[j], s)) for j in range(far, near)])
        a = upto[far]
        for j, f in before[i]:
            a = _sum(a, alpha[j] + (weights.get(f, 0.0) if f else 0.0))
        alpha.append(a + sc[i])
        upto.append(_sum(upto[i], alpha[i]))
    z = upto[n]
    after: list[list[tuple[int, str | None]]] = [[] for _ in spans]
    for i, js in enumerate(before):
        for j, f in js:
            after[j].append((i, f))
    order = sorted(range(n), key=lambda i: spans[i][0])
    starts = [spans[i][0] for i in order]
    since, beta = [0.0] * (n + 1), [0.0] * n
    since[n] = -math.inf
    for at in range(n - 1, -1, -1):
        i = order[at]
        b = _sum(0.0, since[bisect.bisect_left(starts, spans[i][1] + S.NEAR + 1)])
        for k, f in after[i]:
            b = _sum(b, sc[k] + beta[k] + (weights.get(f, 0.0) if f else 0.0))
        beta[i] = b
        since[at] = _sum(since[at + 1], sc[i] + b)
    g: dict[str, float] = defaultdict(float)
    ll = -z
    hit = [(s[0], s[1], s[2]) in gold for s in spans]
    for i, s in enumerate(spans):
        p = math.exp(alpha[i] + beta[i] - z)
        ll += sc[i] * hit[i]
        for f in s[3]:
            g[f] += hit[i] - p
        for j, f in before[i]:
            if f:
                both = hit[i] and hit[j] and not any(ends[j] <= a and z_ <= s[0] for a, z_, _ in gold)
                w = weights.get(f, 0.0)
                ll += w * both
                g[f] += both - math.exp(alpha[j] + w + sc[i] + beta[i] - z)
    return ll, g


def _listed(span: S.Span) -> bool:
    return not span[3][0].startswith(("plain", "any:"))


def train(n: int = 6000, epochs: int = 6, rate: float = 0.25, l2: float = 1e-4, seed: int = 5) -> dict[str, float]:
    """Weights of the segments that a detector or a listed name makes, from sentences that hold no other ones."""
    r = random.Random(seed)
    data = [parse(sentence(r)) for _ in range(n)]
    lattice = [(t, [s for s in S.candidates(t) if _listed(s)], g) for t, g in data]
    return _fit(lattice, {}, ("",), epochs, rate, l2, r)


def train_plain(weights: dict[str, float], n: int = 9000, epochs: int = 6, rate: float = 0.25, l2: float = 1e-4, seed: int = 6) -> dict[str, float]:
    """Weights of all other segments and of the transitions; those of ``weights`` stay."""
    r = random.Random(seed)
    data = [parse(plain_sentence(r) if i % 3 else sentence(r)) for i in range(n)]
    return _fit([(t, S.candidates(t), g) for t, g in data], weights, ("plain", "any:", "next:"), epochs, rate, l2, r)


def _fit(lattice: list, weights: dict[str, float], fitted: tuple[str, ...], epochs: int, rate: float, l2: float, r: random.Random) -> dict[str, float]:
    """Gradient steps of falling size on one sentence at a time."""
    w: dict[str, float] = defaultdict(float, weights)
    for epoch in range(epochs):
        for text, spans, gold in lattice:
            if spans:
                for f, v in gradient(text, spans, gold, w)[1].items():
                    if f.startswith(fitted):
                        w[f] += rate / (1 + epoch) * (v - l2 * w[f])
        r.shuffle(lattice)
    return dict(w)


def main() -> None:
    w = train_plain(train())
    lines = ['"""Fixed values: weights of the span model, as trained by ``pii_train``."""', "", "WEIGHTS = {"]
    lines += [f'    "{k}": {v:.2f},' for k, v in sorted(w.items()) if abs(v) >= 0.05 and (v > 0 or v < S_UNSEEN or not k.startswith("form="))]
    Path(__file__).with_name("pii_weights.py").write_text("\n".join([*lines, "}", ""]))


if __name__ == "__main__":
    main()
