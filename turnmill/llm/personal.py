"""Personal data in free text: a semi-Markov conditional random field over whole spans, and typed placeholders."""

from __future__ import annotations

import json
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

#: Common given names (fixed values).
GIVEN = set(
    "adam alice amara amina ana andreas anita anna anselm anton arthur ben bernd brigitte bruno carla carlos carmen carol chiara chloe christine claire clara daniel david "
    "delphine diana diego dieter dmitri elena elias elisa emily emma erik eva fatima felix fernando frank georg george giulia greta hanna hans heinrich helen helga henri igor "
    "ines ingrid irina isabel ivan jack jacques jan jane javier jean jennifer joana joao john jonas jorge jose joseph juan julia karin karl katharina kevin klaus kwame lara laura "
    "lena leon linda lisa lucas lucia luis luisa maria marie mario mark marta martin mary mateo matteo max mehmet michael miguel mikhail monika natalia nina noor olga oksana olivia "
    "omar oscar pablo patricia paul pavel pedro peter pierre priya rafael ralf renate ricardo robert rosa sandra sara sergei sofia stefan stellan susan svetlana sven tatiana thomas "
    "tomas ursula vera victor viktor vladimir werner yara yusuf zoe".split()
)
#: Their spellings with accents (fixed values).
ACCENTED = set("amélie andré chloé inés joão jorgé josé lucía luís mário márta rené sofía tomás zoë".split())
#: Words for persons by what they are to somebody (fixed values).
RELATIONS = {
    "en": "landlord landlady neighbour neighbor boss doctor dentist teacher colleague cousin manager tenant therapist lawyer roommate flatmate friend brother sister wife husband partner mother father uncle aunt nurse plumber mechanic tutor coach accountant supervisor professor client patient boyfriend girlfriend".split(),
    "es": "casero casera vecino vecina jefe jefa médico médica amigo amiga hermano hermana marido mujer madre padre abogado abogada profesor profesora compañero compañera".split(),
    "de": "vermieter vermieterin nachbar nachbarin chef chefin kollege kollegin arzt ärztin freund freundin bruder schwester mann frau mutter vater anwalt anwältin lehrer lehrerin mitbewohner mitbewohnerin".split(),
    "fr": "propriétaire voisin voisine patron patronne collègue médecin ami amie frère sœur mari femme mère père avocat avocate professeur colocataire".split(),
    "pt": "senhorio senhoria vizinho vizinha chefe médico médica amigo amiga irmão irmã marido mulher mãe pai advogado advogada professor professora colega".split(),
    "ru": "хозяин хозяйка сосед соседка начальник начальница врач друг подруга брат сестра муж жена мать отец юрист учитель учительница коллега".split(),
}
CUES = {
    "intro": r"(?:(?:my|his|her) (?:full )?name(?: is|'s|:)|i am called|me llamo|mi nombre es|soy|ich hei(?:ß|ss)e|mein name ist|je m['’]appelle|mon nom est|(?:eu )?me chamo|meu nome é|меня зовут|signed)[\s:,]*$",
    "role": r"(?:work(?:s|ed|ing)? with|ask for|talk to|speak (?:to|with)|contact|pregunt\w+ por|trabajo con|fragt? (?:am empfang )?nach|arbeite mit|demande[zr]? (?:à voir )?|travaille avec|pergunt\w+ (?:por|pel[oa])|trabalho com|спросите|работаю с)[\s:,]*$",
    "person": r"(?:(?:my|our|his|her|their) (?:\w+ )?(?:" + "|".join(RELATIONS["en"]) + r")|mis? (?:" + "|".join(RELATIONS["es"]) + r")|(?:mein|meine|unser|unsere) (?:" + "|".join(RELATIONS["de"]) + r")|(?:mon|ma|notre) (?:" + "|".join(RELATIONS["fr"]) + r")|(?:meu|minha) (?:"
    + "|".join(RELATIONS["pt"]) + r")|(?:мой|моя|наш|наша) (?:" + "|".join(RELATIONS["ru"]) + r"))(?:,? (?:is|was|called|named|es|ist|heißt|est|é|зовут))?[\s:,]*$",
    "closing": r"(?:regards|best wishes|sincerely|yours truly|saludos|atentamente|viele grü(?:ß|ss)e|mit freundlichen grü(?:ß|ss)en|cordialement|bien à vous|atenciosamente|abraços|cumprimentos|с уважением)(?:,\s*|\s*\n\s*)$",
    "phone": r"(?:call|ring|text|phone|tel|telephone|mobile|cell|whatsapp|fax|dial|reach|number is|my number|mi número|número es|ll[aá]m\w*|tel[eé]fono|m[oó]vil|ruf\w*|meine nummer|handy|telefon|erreich\w*|appel\w*|mon numéro|joindre|téléphone|portable|lig[au]\w*|telefone|celular|telemóvel|meu número|звони\w*|телефон\w*|мой номер)\W(?:[^\n.!?]|\.(?=\S)|(?<=no)\.|(?<=nr)\.){0,22}$",
    "ident": r"(?:\bssn\b|social security|national insurance|passport|passeport|pasaporte|passaporte|reisepass|driver'?s? licen[cs]e|driving licen[cs]e|licen[cs]e no|\bdni\b|\bnie\b|\bnif\b|\bnss\b|iban|steuer-?id|steuernummer|ausweis\w*|sozialversicherung\w*|versicherungsnummer|"
    r"numéro de sécu\w*|sécurité sociale|carte d['’]identité|numéro fiscal|\bcpf\b|\brg\b|\bnib\b|cartão de cidadão|contribuinte|segurança social|identidade|паспорт\w*|инн\b|снилс|account (?:no|number)|kontonummer|\bkonto\b|cuenta|conta bancária|credit card|card number|tax (?:id|number)|taxpayer|\btin\b|nhs number|medicare|"
    r"identity (?:card|number)|\bid (?:card|number|no))(?:[^\n.!?]|\.(?=\S)|(?<=no)\.|(?<=nr)\.){0,22}$",
    "other": r"(?:order|part|version|build|isbn|log|coordinates?|port|score|ticket|invoice|tracking|serial|sku|model|chapter|page|volume|paid|price|commit|release|room|pedido|bestell\w*|commande|artikel\w*|versión|pieza|teil\w*)\W(?:[^\n.!?]|\.(?=\S)|(?<=no)\.){0,24}$",
}
_CUES = {k: re.compile(r"(?:^|(?<=\W))" + v, re.I) for k, v in CUES.items()}
_CAP = r"[^\W\d_a-zà-öø-ÿа-яё][^\W\d_]*(?:[-'’][^\W\d_]+)?"
_EMAIL = re.compile(r"[\w.+%-]+(?:@|＠| ?[(\[] ?at ?[)\]] ?| at (?=[\w-]+ dot ))[\w-]+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?| dot )[\w-]+)+", re.I)
_DIGITS = re.compile(r"(?<![\w@])(?:[+(]\s?)?\d(?:[ \-./()]{0,2}\d)+(?!\w)")
_NUMBER = re.compile(r"(?<![\w@])(?:[A-Z]{1,2}[- ]?)?\d(?:[ \-./()]{0,2}\d)+(?:[- ]?[A-Za-z]\b|[A-Za-z]\d\b)?(?!\w)")
_CODE = re.compile(r"\b(?=[A-Za-z0-9]{6,14}\b)(?=[A-Za-z]{0,4}\d)(?:[A-Za-z]*\d){4,}[A-Za-z0-9]*\b")
_IBAN = re.compile(r"\b[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){3,7}(?: ?[A-Za-z0-9]{1,4})?\b")
_LICENCE = re.compile(r"\b[A-Za-z]\d{3}(?:[- ]\d{4}){2,3}\b|\b[A-Za-z]{2}(?: ?\d{2}){3} ?[A-Za-z]\b|\b\d{2} \d{2} [A-Za-z]\d{3}[A-Za-z0-9]+\b")
_STREETS = (
    re.compile(r"(?:(?:flat|apt\.?|apartment|unit|suite) \w{1,4}, )?\b\d{1,5}[a-z]? (?:[^\W\d_][\w'’.-]* ){1,3}(?:street|st|lane|ln|avenue|ave|road|rd|drive|dr|close|court|boulevard|blvd|terrace|crescent|square|way)\b(?:, (?:apt\.?|flat|unit) \w{1,4})?(?:,\s+(?!and\b|or\b|so\b|but\b)[^\W\d_]\w+(?-i: [A-Z]\w+)?(?: \d{4,6})?)?", re.I),
    re.compile(r"\b(?:[A-ZÄÖÜa-zäöü][\wäöüß-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|damm|ufer|hang|steig)|(?:Am|An der|Im|Zum|Zur|Auf der|Alte|Neue) [A-ZÄÖÜ][\wäöüß]+(?: (?:Straße|Weg|Gasse))?) \d{1,4} ?[a-z]?\b(?:, \d{5} [A-ZÄÖÜ]\w+)?"),
    re.compile(r"\b(?:calle|avenida|avda\.?|plaza|paseo|camino|rua|travessa|praça|largo|alameda|c/) (?:(?:de|del|de la|da|do|das|dos|los|las) )?[^\W\d_]\w+(?: [^\W\d_]\w+){0,3},? (?:n[.º°]+ ?)?\d{1,4}\b(?:, \d{1,2}[.º°]+ ?[A-Z]?)?(?:, \d{4,5}(?:-\d{3})? \w+)?", re.I),
    re.compile(r"\b\d{1,4}(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours) (?:(?:de|du|des|de la|d['’]|la|le) ?)?[^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+){0,3}(?:, \d{5} \w+)?", re.I),
    re.compile(r"\b(?:ул\.?|улица|улице|проспект|пр\.|переулок|пер\.|шоссе|площадь|бульвар|набережная) ?[^\W\d_][\w-]+(?: [^\W\d_][\w-]+){0,2},? ?(?:д\.?|дом)? ?\d{1,4}\w?\b(?:,? кв\.? ?\d+)?", re.I),
)
_PART = r"[^\W\d_]+(?:[-'’][^\W\d_]+)?"
_PARTICLE = r"(?:(?:de|da|do|dos|del|van|von|der|den|di|la|le|al|bin|ibn|Ni|Nic|Mac|Mc) )"
_NAME_AT = (
    re.compile(rf"{_CAP}(?: [A-Z]\.)? {_PARTICLE}{{1,2}}{_CAP}(?![\w@])"),
    re.compile(rf"{_CAP} {_CAP} {_CAP}(?![\w@])"),
    re.compile(rf"{_CAP}(?: [A-Z]\.)? {_CAP}(?![\w@])"),
    re.compile(rf"[^\W\d_]\. ?(?:[^\W\d_]\. ?)?[^\W\d_]{{3,}}(?![\w@])"),
    re.compile(rf"{_CAP}, {_CAP}(?![\w@])"),
    re.compile(rf"{_PART}(?: [^\W\d_]\.)? [^\W\d_]{{3,}}(?![\w@])"),
    re.compile(rf"[^\W\d_]{{3,}}, {_PART}(?![\w@])"),
)
_LAST_FIRST = re.compile(r"([^\W\d_]{3,}), $")
_ORG = re.compile(r"\W*(?:labs?|inc|ltd|gmbh|corp|company|university|street|avenue|lane|road|edition|museum|club|bridge|river|award|festival)\b", re.I)
_CLOSING = set("regards wishes sincerely cheers yours saludos atentamente grüße grüssen grüßen grüsse cordialement vous atenciosamente abraços cumprimentos уважением thanks gracias danke merci obrigado".split())
_STOP = set("me you us it him her them at the a an this that these those meet look arrive stop here".split())
_RUN = re.compile(r"\d[\d ().\-/]{3,}\d|[A-Za-z]-?\d{4,}|\d{4,}[A-Za-z]|[A-Za-z]\d{3}-")
#: What must stand in a turn for the spans of a group to be looked for (lower case).
SIGNS = {
    "email": ("@", "＠", "(at)", "[at]", "( at", "[ at", " dot "),
    "street0": (" street", " st,", " lane", " ln", " avenue", " ave", " road", " rd", " drive", " dr", " close", " court", " terrace", " crescent", " square", " boulevard", " blvd", " way"),
    "street1": ("straße", "strasse", "str. ", "weg ", "gasse ", "platz ", "allee ", "ring ", "damm ", "ufer ", "hang ", "steig ", " am ", "an der ", " im ", "zum ", "zur "),
    "street2": ("calle ", "avenida ", "avda", "plaza ", "paseo ", "camino ", "rua ", "travessa ", "praça ", "largo ", "alameda ", "c/ "),
    "street3": (" rue ", "avenue ", "boulevard ", " place ", "chemin ", "impasse ", "quai ", "allée", "cours "),
    "street4": ("ул.", "улиц", "проспект", "пр.", "переул", "шоссе", "площад", "бульвар", "набереж"),
    "cue": ("name is", "name:", "name's", "i am called", "llamo", "nombre es", "soy ", "heiße", "heisse", "name ist", "appelle", "nom est", "chamo", "nome é", "зовут", "signed", "working with", "work with", "worked with", "works with", "ask for", "talk to", "speak to", "speak with", "landlord", "landlady",
        "neighbour", "neighbor", "boss", "doctor", "dentist", "teacher", "colleague", "cousin", "manager", "tenant", "contact", "unten por", "unte por", "unta por", "trabajo con", "casero", "casera", "vecino", "vecina", "jefe", "jefa", "empfang nach", "fragt nach", "frag nach", "arbeite mit", "vermieter", "vermieterin", "nachbar", "nachbarin", "chef", "chefin", "kollege", "kollegin",
        "demandez", "demande", "travaille avec", "propriétaire", "voisin", "voisine", "patron", "patronne", "collègue", "ergunte por", "ergunte pelo", "ergunte pela", "trabalho com", "senhorio", "senhoria", "vizinho", "vizinha", "спросите", "работаю с", "хозяин", "хозяйка", "сосед", "соседка", "начальник",
        *sorted({w for ws in RELATIONS.values() for w in ws if len(w) > 3}),
        "regards", "best wishes", "sincerely", "yours truly", "saludos", "atentamente", "grüße", "grüsse", "grüßen", "cordialement", "bien à vous", "atenciosamente", "abraços", "cumprimentos", "с уважением"),
}


@lru_cache(maxsize=1)
def _signs():
    import ahocorasick

    a = ahocorasick.Automaton()
    for group, words in SIGNS.items():
        for w in words:
            a.add_word(w, (*(a.get(w) if a.exists(w) else ()), group))
    for g in GIVEN | ACCENTED:
        a.add_word(g, (*(a.get(g) if a.exists(g) else ()), "given"))
    a.make_automaton()
    return a


def _scan(text: str) -> tuple[set[str], set[int]]:
    """Groups of signs in a text, and where a name would begin: after a cue word or at a given name."""
    low = text.lower()
    if len(low) != len(text):
        low = text
    groups: set[str] = set()
    at: set[int] = set()
    for end, own in _signs().iter(low):
        groups.update(own)
        if "cue" in own and not low[end + 1 : end + 2].isalpha():
            m = _GAP.match(text, end + 1)
            at.add(m.end())
        if "given" in own and not low[end + 1 : end + 2].isalpha():
            start = end
            while start and low[start - 1].isalpha():
                start -= 1
            if low[start : end + 1].translate(_PLAIN) in GIVEN:
                at.add(start)
                if left := _LAST_FIRST.search(text, max(0, start - 24), start):
                    at.add(left.start(1))
    if _RUN.search(text):
        groups.add("run")
    return groups, at


_GAP = re.compile(r"(?:in)?(?:,? (?:is|was|called|named|es|ist|heißt|est|é|зовут)\b)?[\s:,]*", re.I)
_PLAIN = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")


def _shape(s: str) -> str:
    s = re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", s))
    return re.sub(r"(.)\1{3,}", r"\1\1\1+", s)[:24]


def candidates(text: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, kind, features) of the spans that could be of a kind. Features are of the whole span."""
    out: dict[tuple[int, int, str], tuple[str, ...]] = {}
    before: dict[int, set[str]] = {}

    def cues(at: int) -> set[str]:
        if at not in before:
            left = text[max(0, at - 64) : at]
            before[at] = {k for k, rx in _CUES.items() if rx.search(left)}
        return before[at]

    groups, starts = _scan(text)
    digits = any(map(str.isdigit, text))
    for m in _EMAIL.finditer(text) if "email" in groups else ():
        s = m[0].rstrip(".")
        top = re.search(r"[\w-]+$", s)[0]
        plain = "@" in s or "＠" in s
        if not plain and _STOP & set(re.split(r"[^\w]+", s.lower())[:1] + re.split(r"\bat\W+", s.lower())[-1].split()[:1]):
            continue
        out[m.start(), m.start() + len(s), "email"] = ("bias", "plain" if plain else "spelled", f"top{min(len(top), 8)}", "user" if re.match(r"[^\W\d_]", s) else "nouser")
    for rx in (_DIGITS, _NUMBER, _CODE, _IBAN, _LICENCE) if "run" in groups else ():
        for m in rx.finditer(text):
            s = m[0].strip()
            a, b = m.start(), m.start() + len(s)
            d = sum(c.isdigit() for c in s)
            if d < 5:
                continue
            c = cues(a)
            letters = sum(ch.isalpha() for ch in s)
            base = ("bias", f"d{min(d, 16)}", f"l{min(letters, 4)}", "plus" if s[0] == "+" else "noplus", "dot" if re.search(r"\d\.\d", s) else "nodot", "date" if re.match(r"(?:19|20)\d\d-\d\d-\d\d", s) else "nodate", *(f"cue_{k}" for k in sorted(c) if k in ("phone", "ident", "other")))
            tail = text[b : b + 12].lower()
            if d >= 7 and letters <= 0:
                out[a, b, "phone"] = (*base, "parens" if "(" in s else "noparens", f"shape{_shape(s)}", "unit" if re.match(r"\s*(?:s|ms|kg|km|€|eur|usd)\b", tail) else "nounit")
            out[a, b, "id_number"] = (*base, "lead" if s[0].isalpha() else "nolead", "nocue" if "ident" not in c else "withcue")
    for k, rx in enumerate(_STREETS):
        for m in rx.finditer(text) if digits and f"street{k}" in groups else ():
            n = re.search(r"\d+", m[0])[0]
            out[m.start(), m.end(), "address"] = ("bias", f"house{len(n)}", f"rx{k}")
    spans = {m.span() for at in starts for rx in _NAME_AT if (m := rx.match(text, at))}
    for a, b in spans:
        s = text[a:b]
        parts = [p for p in re.split(r"[\s,.]+", s) if p]
        low = [p.lower() for p in parts]
        plain = [p.translate(_PLAIN) for p in low]
        c = cues(a) & {"intro", "role", "person", "closing"}
        given = [p in GIVEN for p in plain]
        initial = len(parts[0]) == 1
        if not (any(given) or c) or "," in s and low[0] in _CLOSING or low[-1] in _STOP or len(parts[-1]) < 2:
            continue
        if s.islower() and not any(given) and "intro" not in c:
            continue
        case = "upper" if s.isupper() else "lower" if s.islower() else "caps" if all(p[0].isupper() for p in parts) else "mixed"
        if case == "mixed" and not any(given) and "intro" not in c:
            continue
        out[a, b, "name"] = (
            "bias", f"given{'F' if given[0] else 'L' if given[-1] else '0'}", "initial" if initial else "word", f"case_{case}", "comma" if "," in s else "nocomma", f"parts{len(parts)}",
            *(f"cue_{k}" for k in sorted(c)), "cued" if c else "nocue", f"init_{bool(c)}" if initial else "-", "org" if _ORG.match(text[b : b + 14]) or _ORG.match(" " + parts[-1]) else "noorg",
            "tail" if parts[-1][0].isupper() or s.islower() else "notail", f"{case}_{bool(c)}_{any(given)}",
        )
    return [(a, b, k, f) for (a, b, k), f in out.items()]


def _lattice(cands, weights):
    points = sorted({p for a, b, *_ in cands for p in (a, b)})
    at = {p: i for i, p in enumerate(points)}
    ends = defaultdict(list)
    for j, (a, b, k, f) in enumerate(cands):
        ends[at[b]].append((at[a], j, sum(weights.get((k, x), 0.0) for x in f)))
    return points, ends


def decode(text: str, weights: dict) -> list[tuple[int, int, str]]:
    """The best set of spans that do not overlap, boundaries and kinds chosen together."""
    cands = candidates(text)
    if not cands:
        return []
    points, ends = _lattice(cands, weights)
    best, back = [0.0] * len(points), [None] * len(points)
    for p in range(1, len(points)):
        best[p] = best[p - 1]
        for a, j, s in ends.get(p, ()):
            if best[a] + s > best[p] + 1e-12:
                best[p], back[p] = best[a] + s, (a, j)
    out, p = [], len(points) - 1
    while p > 0:
        if back[p] is None:
            p -= 1
        else:
            p, j = back[p]
            out.append(cands[j][:3])
    return out[::-1]


def _posteriors(cands, weights) -> list[float]:
    """Probability of each candidate under the semi-Markov field, by forward and backward sums."""
    points, ends = _lattice(cands, weights)
    n = len(points)
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    fwd = [0.0] * n
    for p in range(1, n):
        fwd[p] = fwd[p - 1]
        for a, _, s in ends.get(p, ()):
            fwd[p] = add(fwd[p], fwd[a] + s)
    bwd, gone = [float("-inf")] * n, [0.0] * len(cands)
    bwd[n - 1] = 0.0
    for p in range(n - 1, 0, -1):
        bwd[p - 1] = bwd[p] if bwd[p - 1] == float("-inf") else add(bwd[p - 1], bwd[p])
        for a, j, s in ends.get(p, ()):
            bwd[a] = bwd[p] + s if bwd[a] == float("-inf") else add(bwd[a], bwd[p] + s)
            gone[j] = math.exp(min(0.0, fwd[a] + s + bwd[p] - fwd[n - 1])) if bwd[p] > float("-inf") else 0.0
    return gone


#: Frames of the training sentences; a slot in braces is of that kind, one in angle brackets is none.
FRAMES = (
    "Write to {email} please.", "Mail me at {email}, thanks.", "Mein Postfach ist {email}.", "Mi correo es {email}", "the address {email} bounced",
    "Call {phone} after lunch.", "My number is {phone}.", "text {phone} any time", "Ruf mich unter {phone} an.", "Llámame al {phone}.", "Appelle-moi au {phone} demain.", "Meu telefone é {phone}.", "Мой номер {phone}, звони.", "Ring {phone} and wait.", "My number is {phone} and my mail is {email}.",
    "My passport no. is {id_number}.", "They wanted the SSN {id_number} twice.", "Meine IBAN {id_number} stimmt.", "El DNI {id_number} caducó.", "Mon numéro de sécurité sociale est {id_number}.", "O CPF {id_number} está errado.", "Паспорт {id_number} утерян.", "national insurance number {id_number} was typed", "driver's license {id_number} expired", "account number {id_number} was closed",
    "Send it to {address}, please.", "I live at {address} now.", "Ich wohne {address} und warte.", "Vivo en {address} desde mayo.", "J'habite {address} ici.",
    "My name is {name}, hello.", "I work with {name} on this.", "Ask for {name} at noon.", "Ich heiße {name}.", "Me llamo {name}, gracias.", "Je m'appelle {name}.", "My landlord {name} agreed.", "I asked my neighbour {xname} about it.", "My therapist is {xname}.", "our boss {xname} left early", "Mein Nachbar {xname} half uns.", "Mi vecina {xname} llamó.", "Ma voisine {xname} est venue.", "Minha chefe {xname} saiu.", "my name is {xname}, hello", "Ich heiße {xname}.", "My <word> is <Word> <Noun> today.", "my cousin <word> it", "My teacher, <Word>, came.", "my sister <Word> <word> it.", "Regards, {name}", "Saludos, {name}", "Viele Grüße, {name}", "Cordialement, {name}.", "we met {Name} there",
    "The order number was <long>, pending.", "Part number <part> fits.", "Version <version> broke it.", "It listens on port <port> at <ip> here.", "Coordinates were <coord>.", "ISBN <isbn> is the book.", "The log says <stamp> and stops.", "The score was <score> in the end.", "I paid <price> for it.", "Build <build> passed.", "The <org> edition is nicer.", "<street> is closed today.", "Ping @<word> in the tracker.", "Add @app.<word> above it.", "my name is <word> something", "We asked for <Word> parts.", "I work with <org> tools.", "Regards, <given> <letter>.", "Saludos, <given> <letter>.", "In <long> steps it ends.", "call <word> twice", "Ask for <Word> <Noun> there.", "Meet me at the dot on the map.", "Meine Steuer-ID {id_number} fehlt.", "Em casa: {phone}.", "Signed, {name}", "Pregunten por {name} allí.", "Fragt nach {name} bitte.",
)
#: Passes over the training sentences, their number, step and decay.
EPOCHS, SENTENCES, STEP, DECAY = 4, 3_000, 0.25, 1e-4


def _filled(rng: random.Random) -> tuple[str, set[tuple[int, int, str]]]:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda n=6: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(n // 2))
    given = rng.choice(sorted(GIVEN))
    sur = word(rng.choice((6, 8)))

    def name() -> str:
        g, s = given.title(), sur.title()
        form = rng.choice((f"{g} {s}", f"{g} {s}", f"{s}, {g}", f"{g[0]}. {s}", f"{g} {rng.choice('ABKR')}. {s}"))
        form = form if rng.random() < 0.85 else form.replace(g, word(6).title())
        return rng.choice((form, form, form.upper(), form.lower()))

    fill = {
        "email": lambda: rng.choice(("{u}@{d}.org", "{u}@{d}.example.net", "{u} (at) {d}.test", "{u} [at] {d} [dot] example", "{u} at {d} dot org", "{u}＠{d}.com")).format(u=rng.choice((given, f"{given}.{sur}", f"{given}_{sur}{digits(2)}")), d=word()),
        "phone": lambda: rng.choice(("({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "+1 {a} {b} {c}", "1-{a}-{b}-{c}", "+1{a}{b}{c}", "+49 30 {b}{c}", "030 {b}{a} {x}", "030/{b}{x}-{a}", "+34 {a} {b} {y}", "0034-{a}-{b}-{y}", "+44 (0)20 {c} {e}", "020 {c} {e}", "01 {x} {x} {x} {x}")).format(a=digits(3), b=digits(3), c=digits(4), e=digits(4), x=digits(2), y=digits(3)),
        "id_number": lambda: rng.choice(("{a}-{x}-{c}", "{a} {x} {c}", "X{c}{a}", "L{c}{b}X{y}", "D{a}-{c}-{e}", "QQ {x} {x} {x} A", "{c}{e}-X", "X-{c}{a}-Q", "DE{x} {c} {e} {c} {e} {x}", "{x} {a} {b} {a}", "{a}.{b}.{a}-{x}", "1 {x} {x} {x} {a} {b}", "{c}{e}{x}", "{c} {a}{b}")).format(a=digits(3), b=digits(3), c=digits(4), e=digits(4), x=digits(2), y=digits(1)),
        "address": lambda: rng.choice(("{n} {W} Street, {V}", "{n} {W} {V} Lane, Apt {k}, {U} {z}", "flat {k}, {n} {W} {V} Lane", "{n} {w} {v} avenue, {u}", "{W}straße {n}a", "Am {W} {n}, {z} {V}", "Calle del {W} {n}, {k}º B", "Plaza de {W}, {n}", "{n}, rue du {W}", "Rua {W}, {n}", "ул. Лесная, д. {n}")).format(n=rng.randint(1, 180), k=rng.randint(1, 9), z=digits(5), w=word(), v=word(), u=word(), W=word().title(), V=word().title(), U=word().title()),
        "xname": lambda: rng.choice(("{a} {b}", "{a} {b}", "{a} {p} {b}", "{a} {c} {b}")).format(a=word(6).title(), b=sur.title(), c=word(4).title(), p=rng.choice(("van", "de", "Ni", "von der"))),
        "name": name, "Name": lambda: f"{given.title()} {sur.title()}",
        "long": lambda: digits(10), "part": lambda: f"X{digits(2)}-{digits(4)}-{digits(3)}", "version": lambda: f"{digits(1)}.{digits(2)}.{digits(3)}", "port": lambda: digits(4), "ip": lambda: f"10.{digits(1)}.{digits(2)}.1",
        "coord": lambda: f"{digits(2)}.{digits(5)}, {digits(2)}.{digits(5)}", "isbn": lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", "stamp": lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)} 1{digits(1)}:22:33", "score": lambda: f"{digits(3)}-{digits(3)}", "price": lambda: f"1.{digits(3)},00", "build": lambda: f"2024{digits(4)}.{digits(1)}",
        "org": lambda: f"{word().title()} Labs", "street": lambda: f"{word().title()} {word().title()} Avenue", "word": lambda: word(8), "Word": lambda: word().title(), "Noun": lambda: word().title(), "given": lambda: given.title(), "letter": lambda: rng.choice("ABCDK"),
    }
    text, gold, at = "", set(), 0
    frame = rng.choice(FRAMES)
    for m in re.finditer(r"[{<](\w+)[}>]", frame):
        text += frame[at : m.start()]
        v = fill[m[1]]()
        if m[0][0] == "{":
            gold.add((len(text), len(text) + len(v), "name" if m[1] == "xname" else m[1].lower()))
        text += v
        at = m.end()
    return text + frame[at:], gold


@lru_cache(maxsize=1)
def trained(seed: int = 5) -> dict:
    """Feature weights by stochastic gradient of the log likelihood, on ``SENTENCES`` filled frames. Always the same."""
    rng = random.Random(seed)
    data = [_filled(rng) for _ in range(SENTENCES)]
    weights: dict = defaultdict(float)
    for k in KINDS:
        weights[k, "bias"] = -0.5
    for epoch in range(EPOCHS):
        step = STEP / (1 + epoch)
        for text, gold in data:
            cands = candidates(text)
            if not cands:
                continue
            # a gold span that no candidate meets exactly is taught by the candidate inside it that covers most
            want = {}
            for a, b, k in gold:
                inside = [(min(b, y) - max(a, x), -(y - x), j) for j, (x, y, kind, _) in enumerate(cands) if kind == k and x < b and y > a]
                if inside:
                    want[max(inside)[2]] = 1.0
            for j, p in enumerate(_posteriors(cands, weights)):
                g = want.get(j, 0.0) - p
                if abs(g) > 1e-3:
                    for x in cands[j][3]:
                        weights[cands[j][2], x] += step * (g - DECAY * weights[cands[j][2], x])
    return dict(weights)


def find(text: str | None, weights: dict) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of personal data in one text, in order; none in null, blank and plain text."""
    return decode(text, weights) if text else []


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join([*out, text[at:]])


def _array(value: str | None) -> list:
    try:
        got = json.loads(value) if value else []
    except ValueError:
        return []
    return got if isinstance(got, list) else []


def find_personal(df: DataFrame, ident: str, conversation: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(*extra, ``ident``, turn_no, kind): the kinds of personal data in each turn, each once.

    ``turn_no`` counts the elements of the JSON array from 0, whatever they are. Null and broken arrays and
    turns without text have none; repeated rows give repeated results. The field's weights are trained once
    on the driver from generated sentences and sent along. Nothing is shuffled.
    """
    schema = T.StructType([*(df.schema[c] for c in (*extra, ident)), T.StructField("turn_no", T.LongType()), T.StructField("kind", T.StringType())])

    w = trained()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            keys = b[[*extra, ident]].itertuples(index=False, name=None)
            for key, v in zip(keys, b[conversation], strict=True):
                for no, t in enumerate(_array(v)):
                    c = t.get("content") if isinstance(t, dict) else None
                    if isinstance(c, str):
                        out += [(*key, no, k) for k in {k for *_, k in find(c, w)}]
            yield pd.DataFrame(out, columns=[*extra, ident, "turn_no", "kind"])

    return df.select(*extra, ident, conversation).mapInPandas(search, schema)


def redact_conversations(df: DataFrame, conversation: str) -> DataFrame:
    """``df`` with the personal data in ``conversation`` replaced by typed placeholders, all else unchanged.

    A row without any keeps its string byte for byte; in the others the array is written anew with the
    same keys in the same order, non-ASCII characters kept.
    """

    w = trained()

    @F.pandas_udf(T.StringType())
    def redacted(s: pd.Series) -> pd.Series:

        def one(v):
            turns, changed = _array(v), False
            for t in turns:
                c = t.get("content") if isinstance(t, dict) else None
                if isinstance(c, str) and (spans := find(c, w)):
                    t["content"], changed = redact(c, spans), True
            return json.dumps(turns, ensure_ascii=False) if changed else v

        return s.map(one)

    return df.withColumn(conversation, redacted(F.col(f"`{conversation}`")))
