"""Personal information inside free text: find it, replace it, keep equal values linked.

Every match becomes the placeholder of its type; the rest of the text stays as
it is. The record of a match carries a pseudonym made by a format-preserving
Feistel permutation under a secret key, which the caller must give: digits stay
digits, letters of a script letters of that script, dates dates, and no letter
or digit of the value is handed on as it is. A number that passes the check of a
public numbering scheme has its payload permuted and its check digits computed
anew, so it is valid in the same scheme. Words that only label a value (ext.,
[at], Street) stay. Equal values get equal links in every document, whatever
their separators: the link is the permuted canonical value, from which restore()
gets it back, while the pseudonym keeps the format found.

Detection works on a look-alike-free copy of the text that keeps its places
(full-width forms, kinds of space and hyphen, Greek or Cyrillic letters inside
Latin words, invisible characters), in the order e-mail, id-number, phone,
street-address, person-name; what one type has taken, later ones do not see.

Defined results: null and empty bodies have no match. Lines count from 1 and end
at LF, CRLF or CR. A pattern that the type table does not list is not looked for.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from datetime import date, timedelta
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.lookalike import INVISIBLE, PROTOTYPES
from pagewright.session import spread

# --- format-preserving permutation ------------------------------------------------------------

ROUNDS = 10
HAN_FIRST, HAN_COUNT = 0x4E00, 0x9FA6 - 0x4E00
FIRST_DAY, DAYS = date(1900, 1, 1), 73_049  # to 2099-12-31


def _round(key: bytes, tweak: bytes, i: int, half: int, size: int) -> int:
    h = hashlib.blake2b(b"%d|%d|" % (i, half) + tweak, key=key, digest_size=16).digest()
    return int.from_bytes(h, "big") % size


def feistel(value: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """Keyed permutation of range(size): a Feistel network over two near-square halves, walking on while outside."""
    if size <= 1:
        return value
    a = max(2, int(size**0.5))
    b = -(-size // a)
    if a < b:
        a, b = b, a
    while True:
        left, right = divmod(value, b)  # left < a, right < b
        for i in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if i % 2:
                left = (left + sign * _round(key, tweak, i, right, a)) % a
            else:
                right = (right + sign * _round(key, tweak, i, left, b)) % b
        value = left * b + right
        if value < size:
            return value


def permute_date(day: date, key: bytes, inverse: bool = False) -> date:
    """A date of 1900 to 2099 becomes another one; days outside stay."""
    n = (day - FIRST_DAY).days
    return FIRST_DAY + timedelta(days=feistel(n, DAYS, key, b"date", inverse)) if 0 <= n < DAYS else day


@cache
def _alphabets() -> tuple[dict[str, tuple[int, int]], list[str]]:
    """character -> (alphabet, place), and the alphabets: letters, marks and numbers of one script, block and category; digits go from 0 to 9.

    Built from the names of the character database; groups of fewer than eight join those of all small scripts.
    """
    groups: dict[tuple, list[str]] = {}
    for code in range(0x80, 0x32400):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind[0] in "LMN":
            words = unicodedata.name(ch, "UNNAMED").split()
            block = 0x4E if words[0] == "CJK" and 0x4E00 <= code < 0xA000 else code >> 8
            script = (*words[:2],) if words[0] == "HANGUL" else (words[0], block)
            groups.setdefault((code - unicodedata.digit(ch),) if kind == "Nd" else (kind, *script), []).append(ch)
    for k in [k for k, v in groups.items() if len(v) < 8]:
        groups.setdefault(("small",), []).extend(groups.pop(k))
    alphabets = ["0123456789", "abcdefghijklmnopqrstuvwxyz", *("".join(v) for v in groups.values())]
    return {ch: (k, at) for k, alphabet in enumerate(alphabets) for at, ch in enumerate(alphabet)}, alphabets


def permute(text: str, key: bytes, tweak: bytes, inverse: bool = False, where: list[int] | None = None) -> str:
    """The text with its letters, marks and digits permuted, those of each alphabet as one number; ASCII letters keep their case. where limits it to some places."""
    places, alphabets = _alphabets()
    chars, of = list(text), {}
    for i in range(len(chars)) if where is None else where:
        ch = chars[i].lower() if chars[i].isascii() else chars[i]
        if ch in places:
            of.setdefault(places[ch][0], []).append(i)
    for k, at in of.items():
        alphabet, value = alphabets[k], 0
        for i in at:
            value = value * len(alphabet) + places[chars[i].lower() if chars[i].isascii() else chars[i]][1]
        value = feistel(value, len(alphabet) ** len(at), key, tweak + b"|%d|%d" % (k, len(at)), inverse)
        for i in reversed(at):
            value, d = divmod(value, len(alphabet))
            chars[i] = alphabet[d].upper() if chars[i].isascii() and chars[i].isupper() else alphabet[d]
    return "".join(chars)


# --- numbers with check digits ----------------------------------------------------------------


def _weighted(digits: str, weights: tuple[int, ...]) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights))


def _check_cn(p: str) -> str:
    return "10X98765432"[_weighted(p, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)) % 11]


def _check_es(p: str) -> str:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(p.translate(str.maketrans("XYZ", "012"))) % 23]


def _check_fr(p: str) -> str:
    return f"{97 - int(p) % 97:02d}"


def _check_nl(p: str) -> str | None:
    r = _weighted(p, (9, 8, 7, 6, 5, 4, 3, 2)) % 11
    return str(r) if r < 10 else None


def _check_pt(p: str) -> str:
    r = 11 - _weighted(p, (9, 8, 7, 6, 5, 4, 3, 2)) % 11
    return str(r if r < 10 else 0)


def _check_br(p: str) -> str:
    for first in (10, 11):
        r = _weighted(p, tuple(range(first, 1, -1))) * 10 % 11
        p += str(r % 10)
    return p[9:]


def _check_de(p: str) -> str:
    product = 10
    for d in p:
        total = (int(d) + product) % 10 or 10
        product = total * 2 % 11
    return str((11 - product) % 10)


def _check_snils(p: str) -> str:
    return f"{_weighted(p, (9, 8, 7, 6, 5, 4, 3, 2, 1)) % 101 % 100:02d}"


def _check_inn10(p: str) -> str:
    return str(_weighted(p, (2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10)


def _check_inn12(p: str) -> str:
    a = str(_weighted(p, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10)
    return a + str(_weighted(p + a, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10)


def _check_jp(p: str) -> str:
    r = _weighted(p, (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)) % 11
    return str(0 if r <= 1 else 11 - r)


def _check_luhn(p: str) -> str:
    total = sum(sum(divmod(int(d) * 2, 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(p)))
    return str(-total % 10)


# Public numbering schemes, the form of their payload, and how the check characters follow from it.
SCHEMES = {
    "cn-resident": (r"\d{17}", _check_cn), "es-dni": (r"\d{8}", _check_es), "es-nie": (r"[XYZ]\d{7}", _check_es), "fr-nir": (r"[12]\d{12}", _check_fr),
    "br-cpf": (r"\d{9}", _check_br), "ru-snils": (r"\d{9}", _check_snils), "de-tax": (r"[1-9]\d{9}", _check_de), "jp-number": (r"\d{11}", _check_jp),
    "ru-inn-12": (r"\d{10}", _check_inn12), "ru-inn-10": (r"\d{9}", _check_inn10), "nl-bsn": (r"\d{8}", _check_nl), "pt-nif": (r"\d{8}", _check_pt), "luhn": (r"\d{8}|\d{15}", _check_luhn),
}


def _birth(payload: str) -> date | None:
    try:
        day = date(int(payload[6:10]), int(payload[10:12]), int(payload[12:14]))
    except ValueError:
        return None
    return day if 0 <= (day - FIRST_DAY).days < DAYS else None


def scheme_of(compact: str) -> str | None:
    """The first scheme whose check a number without separators passes."""
    if not compact.isascii():
        return None
    for name, (form, check) in SCHEMES.items():
        for m in (re.match(rf"(?:{form})$", compact[:cut]) for cut in (len(compact) - 1, len(compact) - 2)):
            if m and check(m[0]) == compact[m.end() :] and (name != "cn-resident" or _birth(m[0])):
                return name
    return None


def permute_valid(compact: str, scheme: str, key: bytes, inverse: bool = False) -> str:
    """Another number that the scheme holds valid: payload permuted, a birth date to a birth date, check characters anew."""
    form, check = SCHEMES[scheme]
    cut = next(c for c in (len(compact) - 1, len(compact) - 2) if c > 0 and re.fullmatch(form, compact[:c]) and check(compact[:c]) == compact[c:])
    payload, tweak = compact[:cut], b"id|" + scheme.encode()
    if scheme == "cn-resident":
        day = permute_date(_birth(payload), key, inverse).strftime("%Y%m%d")
        rest = permute(payload[:6] + payload[14:], key, tweak, inverse)
        payload = rest[:6] + day + rest[6:]
    else:
        while True:  # walks on while the payload has no check digit or leaves the form
            payload = permute(payload, key, tweak, inverse, [k for k, ch in enumerate(payload) if ch.isdigit()])
            if re.fullmatch(form, payload) and check(payload) is not None:
                break
    return payload + check(payload)


# --- fixed values: words that mark personal data ---------------------------------------------

GIVEN_NAMES = frozenset(
    """aaron ada adam ahmed alan albert alex alexander alexandra alice alina amelie amir amira ana anders andrea andrei anke anna anne antonio
    anton aylin beatriz ben bernd bianca bruno camille carla carlos carmen caroline charles charlotte chloe christian claire clara daniel
    david diego dirk dmitri eduardo elena elif elisa elise emil emily emma eric erik eva fatima felix fernando finn francesca francois
    frank franziska gabriel georg george giulia greta gustav hannah hans harriet heidi helen helena helene henrik hugo ibrahim igor ines
    ingrid irina iris isabel ivan jack jakob james jan jana jane javier jean jerome joana joao johanna john jonas jorge jose judith julia
    julie kai karin karl katarina katja klara klaus kurt lara lars laura lea leila lena leon liam lina linda lisa louis lucas lucia luis
    luisa lukas magda mai manuel marc marco maria marie marina mario mark marta martin mateo mathilde matteo max mehmet mei mia michael
    miguel mikhail mira miriam mohamed monika nadia natalia nicolas nils nina noah nora nuria olaf olga oliver omar oscar oskar pablo paul
    paula paulo pavel pedro peter philippe pierre priya rafael raj ricardo robert rosa ruben sabine samir sandra sara sarah sebastian
    sergei simon sofia sophie soren stefan susan svetlana tariq teresa thomas tim tomas ulrike valeria vera victor viktor walter yusuf zoe""".split()
)
PARTICLES = r"(?:(?:de[ ]la|de[ ]las|de[ ]los|van[ ]der|van[ ]den|von[ ]der|de|del|della|da|dos|di|du|van|von|der|ten|ter|bin|al|el|la|le)[ ]+)"
# Words that follow a given name without being a surname, or stand in titles, places and methods.
NOT_SURNAMES = frozenset(
    """street avenue road lane close blvd boulevard square dashboard dataset model method team layer norm descent momentum precision falls
    island river lake project protocol algorithm theorem score loss kernel chain index cluster server library release version
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    the this that these those and or but for with from into ship address call see read also commit ticket table figure section chapter""".split()
)
NAME_CUES = (
    """reviewed by|approved by|written by|edited by|reported by|checked by|signed by|prepared by|interview with|thanks to|contact person|on behalf of|regards,|cheers,|sincerely,
    |geprüft von|das gespräch führte|gespräch mit|dank an|gruß,|grüße,|ansprechpartner|ansprechpartnerin|relu par|revu par|rédigé par|entretien avec|merci à|cordialement,
    |revisado por|escrito por|entrevista con|gracias a|saludos,|entrevista com|obrigado a|obrigada a|revisto por|nagekeken door|gesprek met|met dank aan|groet,|groeten,
    |проверил|проверила|интервью с|благодарим|审阅人|レビュー"""
).replace("\n    ", "").split("|")
PHONE_CUES = r"(?:t[eé]l[eé]?f?(?:on[eo]?|ono)?|phone|call|pager|fax|mobile|cell|hotline|line|dial|ring|handy|bitte|rufnummer|appeler|portable|llamar|llame|m[oó]vil|ligar|telemóvel|bel|bellen|тел|телефон|звонить|電話|电话|手机|拨打|致电|热线)"
ID_CUES = (
    """ssn|social security|tax id|taxpayer id|tax identification|tin|itin|national insurance|nino|passport|identity card|id card|insurance number|insurance no
    |personalausweis|ausweis|ausweis-nr|reisepass|steuer-id|steuerid|steueridentifikation|steuer-|sozialversicherung|sozialversicherungs|sv-|krankenversicherungs|rentenversicherungs
    |sécurité sociale|passeport|carte d'identité|carte d’identité|cni|numéro fiscal|pasaporte|nie|nif|dni|documento de identidad|seguridad social|passaporte|cpf|cartão de cidadão
    |bsn|burgerservice|paspoort|identiteitskaart|паспорт|инн|снилс|身份证|护照|社保|社保卡|税号|マイナンバー|個人番号|旅券|パスポート"""
).replace("\n    ", "").split("|")
MAIL_CUES = ("(at)", "( at )", "[at]", "[ at ]", "{at}", "<at>", "(@)", "[@]", " dot ", "(dot)", "[dot]", "[ dot ]", "(arroba)", "[ät]", "(ät)")
COMPOUND_SURNAMES = "欧阳|司马|上官|夏侯|诸葛|东方|赫连|皇甫|尉迟|公孙|慕容|宇文|长孙|司徒|令狐|澹台|闻人|百里|南宫|独孤|端木|西门|轩辕|呼延|第五|申屠|太史|钟离|濮阳|淳于|单于|公冶|宗政|仲孙|歐陽|諸葛|東方|慕容|長孫|司徒|聞人"
SINGLE_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蔡蒋余于杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
ZH_BEFORE = r"(?:审阅人|审核人|作者|负责人|联系人|记录人|撰稿人|访谈人|受访人|编辑|姓名|采访|访谈|感谢|致谢|鸣谢|由|与|和|——|—)[：:\s]*"
ZH_AFTER = r"(?=提供|审阅|审核|负责|编写|撰写|整理|记录|主持|不同意|认为|表示|指出|完成|采访|老师|先生|女士|博士|教授|同学|的|，|。|、|；|：|\s|[|<（(,.;]|$)"

# Longest local part and domain that mail allows; an address has its parts within so many characters of its street word.
LOCAL_MAX, DOMAIN_MAX, ADDRESS_MAX = 64, 255, 160

# --- patterns --------------------------------------------------------------------------------

_ATEXT = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_+-])?"
_DOMAIN = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9-]*[A-Za-z]"
_AT = r"[ \t]*[\[({<][ \t]*(?:at|@|arroba|ät|собака)[ \t]*[\])}>][ \t]*"
_DOT = r"(?:[ \t]*[\[({<][ \t]*(?:dot|\.|punkt|punto|point|точка)[ \t]*[\])}>][ \t]*|\.)"
_LABELS = rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z][A-Za-z0-9-]*[A-Za-z]"
_LOCAL_END = re.compile(rf"{_ATEXT}$", re.A)
_DOMAIN_START = re.compile(rf"@{_DOMAIN}", re.A)
EMAIL_MARKED = re.compile(rf"(?i){_ATEXT}(?:{_AT}{_LABELS}|@{_LABELS})", re.A)
EMAIL_SPELLED = re.compile(rf"(?i)\b{_ATEXT} (?:at|\(at\)|\[at\]) [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+\b", re.A)

_CODE = r"[A-Z]{0,2}\d?[A-Z]{0,2}(?:[ .\-/]?[A-Z0-9]){4,20}"
ID_TAIL = re.compile(rf"(?i:s?[а-яё]{{0,3}}(?:-?nummer|号码?|件号|番号)?)[ \t]*(?i:(?:is|no\.?|nr\.?|n°|nº|number|numéro|número|номер)[ \t]*){{0,2}}[:：#]?[ \t]*({_CODE})(?![A-Za-z0-9])")
ID_BARE = re.compile(r"(?<![\w\-./])(?:\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)|[1-9]\d{5}(?:18|19|20)\d{2}(?:0\d|1[0-2])[0-3]\d\d{3}[\dXx](?!\w)|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?!\w)|\d{8}[A-HJ-NP-TV-Z](?!\w)|[XYZ]-?\d{7}-?[A-Z](?!\w))", re.A)

DIGITS = re.compile(r"(?<![\w@#$€£+])(?<![\w][./:\-])\+?[(]?\+?\d(?:[\d ()./\-]{4,24})\d(?!\w)(?:[ ,]{0,2}(?:ext|x|Durchwahl|poste|ramal|доб|转|分机)\.? ?\d{1,6})?", re.A)
EXTENSION = re.compile(r"[ ,]{0,2}(?:ext|x|Durchwahl|poste|ramal|доб|转|分机)\.? ?\d{1,6}$", re.A)
PHONE_FORMS = [
    re.compile(p, re.A)
    for p in (
        r"\(?\+\d{1,3}\)?[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d(?:[ .\-/]?\d){6,12}",
        r"\(0?\d{2,5}\)[ ]?\d{3,5}[ \-.]?\d{3,5}",
        r"00[1-9]\d(?:[ \-./]?\d){7,12}",
        r"0\d{1,4}[ /\-]\d{5,8}",
        r"0\d{2,4}[ /\-]\d{3,4}[ \-]\d{3,4}",
        r"0\d(?:[ .\-]\d{2}){4}",
        r"\d{3}[\-. ]\d{3}[\-. ]\d{4}",
        r"[689]\d{2}(?:[\- ]\d{2}){3}",
        r"1\d{2}[ \-]\d{4}[ \-]\d{4}",
        r"1[3-9]\d{9}",
    )
]
_CUE_BEFORE = re.compile(rf"(?i){PHONE_CUES}[^\d\n\r]{{0,24}}$")
_BAD_BEFORE = re.compile(r"(?i)(?:isbn|doi|issn|run|ticket|commit|version|v|sizes?|rate|rows)[ :#.]*$")

_MARK = r"̀-ͯ"
_UP = r"A-ZÀ-ÖØ-ÞĀ-ɏΑ-ΩЀ-Я"
_IN = rf"A-Za-z0-9À-ÖØ-öø-ɏͰ-ӿ{_MARK}"
_CAP = rf"[{_UP}][{_IN}'’\-]*"
_TOWN = rf"(?:{_CAP}(?:(?:[ \-](?:am|an|der|im|bei|sur|sous|les|la|le|de|del|do|da|upon|on))*[ \-]{_CAP}){{0,3}})"
# Kind of address: words that hint at it, what must follow or precede the hint, and the pattern.
_STREET_END = re.compile(r"(?![A-Za-zÀ-ÿ])")
_NUMBER_NEXT = re.compile(r" ?\d")
_TOWN_NEAR = re.compile(r"[^\n\r,]{2,48}\d[^\n\r,]{0,3}, \d{5} ")
_CAPITAL_NEXT = re.compile(r"[^\n\r]{0,24}\d|[^\n\r]{0,48}, ?\d")
_NUMBER_BEFORE = re.compile(r"\d ?(?:bis|ter|quater|[A-D])?,? $")
_WORDS_BEFORE = re.compile(r"\d[A-Za-z]? (?:[^\s,.;]+ ){1,3}$")
_DIGIT_BEFORE = re.compile(r"\d ?$")
ADDRESSES = [
    (("street", "st", "avenue", "ave", "close", "lane", "ln", "road", "rd", "blvd", "boulevard", "drive", "dr", "court", "ct", "way", "terrace", "square", "place", "crescent", "row", "hill", "parkway", "gardens"), _WORDS_BEFORE, _STREET_END, re.compile(rf"(?:(?:Flat|Apt\.?|Unit|Suite|Room) \d+\w?, )?(?<![\w.])\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:Street|St\b\.?|Avenue|Ave\b\.?|Close|Lane|Ln\b\.?|Road|Rd\b\.?|Blvd\b\.?|Boulevard|Drive|Dr\b\.?|Court|Ct\b\.?|Way|Terrace|Square|Place|Crescent|Row|Hill|Parkway|Gardens)(?!\w)(?:, (?:Apt\.?|Flat|Unit|Suite) \d+\w?)?(?:, {_CAP}(?: {_CAP}){{0,2}}(?: \d{{5}}(?!\d))?)?")),
    (("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "ring", "damm", "ufer", "chaussee", "steig", "pfad", "hof"), None, _NUMBER_NEXT, re.compile(rf"(?:{_CAP}[ -])?(?:{_CAP})?(?:[sS]traße|[sS]trasse|[sS]tr\.|[wW]eg|[aA]llee|[gG]asse|[pP]latz|[rR]ing|[dD]amm|[uU]fer|[cC]haussee|[sS]teig|[pP]fad|hof) ?\d{{1,4}}(?: ?[a-z](?!\w))?(?:, \d{{5}} {_TOWN})?")),
    (("am ", "an der ", "an den ", "im ", "in der ", "zum ", "zur ", "auf dem ", "auf der ", "unter den ", "vor dem "), None, _TOWN_NEAR, re.compile(rf"(?<!\w)(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|Vor dem) {_CAP}(?: {_CAP})? \d{{1,4}}(?: ?[a-z](?!\w))?, \d{{5}} {_TOWN}")),
    (("rue ", "avenue ", "av. ", "chemin ", "boulevard ", "bd ", "place ", "allée ", "impasse ", "quai ", "route ", "cours ", "passage ", "square ", "ruelle ", "sentier "), _NUMBER_BEFORE, None, re.compile(rf"(?<![\w.])\d{{1,4}}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:rue|avenue|av\.|chemin|boulevard|bd|place|allée|impasse|quai|route|cours|passage|square|ruelle|sentier) (?:(?:de la |de l['’]|du |des |de |d['’]|aux? )?{_CAP})(?: (?:(?:de |du |des |la |le )*){_CAP}){{0,2}}(?:, \d{{5}} {_TOWN})?")),
    (("calle ", "c/", "plaza ", "avda", "avenida ", "paseo ", "camino ", "ronda ", "rua ", "praça ", "travessa ", "largo ", "estrada "), None, _CAPITAL_NEXT, re.compile(rf"(?<!\w)(?:Calle|C/|Plaza|Avda\.?|Avenida|Paseo|Camino|Ronda|Rua|Praça|Travessa|Largo|Estrada) ?(?:(?:de las|de los|de la|del|de|das|dos|da|do) )?{_CAP}(?: (?:(?:de|del|da|do|la) )?{_CAP}){{0,3}},? ?(?:n[º°.]? ?)?\d{{1,4}}(?!\d)(?:, ?\d{{1,2}}[ºª°o] ?(?:[A-Z](?!\w)|izq|dcha)?)?(?:, \d{{5}} {_TOWN})?")),
    (("straat ", "laan ", "plein ", "gracht ", "kade ", "dijk ", "singel ", "steeg "), None, _NUMBER_NEXT, re.compile(rf"{_CAP}(?:straat|laan|weg|plein|gracht|kade|dijk|singel|steeg) \d{{1,4}}(?: ?[a-z](?!\w))?(?:, \d{{4}} ?[A-Z]{{2}} {_TOWN})?")),
    (("ул.", "улица", "просп.", "проспект", "пер.", "переулок", "шоссе", "набережная"), None, _CAPITAL_NEXT, re.compile(r"(?:ул\.|улица|просп\.|проспект|пер\.|переулок|шоссе|набережная) ?[А-ЯЁ][а-яё-]+(?: [А-ЯЁ]?[а-яё-]+){0,2},? ?(?:д\. ?|дом )?\d{1,4}(?:,? ?(?:кв\.|квартира) ?\d+)?")),
    (("号", "號", "丁目"), _DIGIT_BEFORE, None, re.compile(r"(?:[^\W\d_a-zA-Z到在于址为是寄由从至]{2,3}[省市区县])*[^\W\d_a-zA-Z到在于址为是寄由从至省市区县]{1,7}(?:大道|胡同|路|街|巷|道|弄) ?\d{1,5} ?[号號](?:[之\-]\d+)?(?: ?\d{1,5} ?(?:室|单元|号楼|栋|楼|层))*|[^\W\d_a-zA-Z]{2,4}[都道府県][^\W\d_a-zA-Z]{1,6}[市区町村][^\W\d_a-zA-Z]{1,6}\d{1,3}(?:丁目|-)\d{1,3}(?:番地?|-)?\d{0,3}号?")),
]

CAPITAL = re.compile(rf"(?<![{_IN}_@.+\-/'’])[{_UP}][{_IN}'’\-]*[{_IN}]")
_SURNAME = rf"(?:[{_UP}]['’])?[{_UP}][{_IN}'’\-]*[{_IN}]"
_DIRECT = re.compile(rf"(?:[ ]+[{_UP}]\.){{0,2}}[ ]+(?:(?i:{PARTICLES}))*({_SURNAME})")
_BEFORE_COMMA = re.compile(rf"((?:(?i:{PARTICLES}))*{_SURNAME}),[ ]+$")
_CUED = re.compile(rf"(?:in|person)?[ \t]*[:：]?[ \t]*(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Mme|M|Sra?|Sr)\.?[ ]+)?(?P<name>{_SURNAME}(?:[ ]+[{_UP}]\.)?,?[ ]+(?:(?i:{PARTICLES}))*{_SURNAME})")
_FREE_START = re.compile(rf"(?i)(?:^|[\n\r|>*:：.!?。！？—–\-(\[぀-鿿]|{"|".join(map(re.escape, NAME_CUES))})[ \t]*(?:Dr\.?[ ]+)?$")
_FREE_END = re.compile(r"[ ]*(?:$|[\n\r|<(\[;:.])")
ZH_COMPOUND = re.compile(rf"(?:{COMPOUND_SURNAMES})[一-鿿]{{2}}")
ZH_CUED = re.compile(rf"{ZH_BEFORE}(?P<name>(?:{COMPOUND_SURNAMES})[一-鿿]{{1,2}}|[{SINGLE_SURNAMES}][一-鿿]{{1,2}}?){ZH_AFTER}")
ZH_CELL = re.compile(rf"(?m)(?:^|\|)[ \t]*(?P<name>[{SINGLE_SURNAMES}][一-鿿]{{1,2}})[ \t]*\|")
ZH_AMBIGUOUS = re.compile(r"东方|百里|第五|单于|太史")

_FLAT = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: " " for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)} | {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)}
_FLAT_HINT = re.compile("[\u00a0\u2000-\u200a\u202f\u205f\u3000\u2010-\u2013\u2212\uff01-\uff5e]")
_TOUCH = re.compile(r"[A-Za-z][Ͱ-ԯ]|[Ͱ-ԯ][A-Za-z]")
_MIXED = re.compile(r"[^\W\d_]*(?:[A-Za-z][Ͱ-ԯ]|[Ͱ-ԯ][A-Za-z])[^\W\d_]*")


def plain_copy(text: str) -> tuple[str, list[int] | None]:
    """A copy without look-alikes, and the place of each of its characters in the text (null: the same places)."""
    if text.isascii():
        return text, None
    places = None
    if INVISIBLE.search(text):
        places = [i for i, ch in enumerate(text) if not INVISIBLE.match(ch)]
        text = "".join([text[i] for i in places])
    if _FLAT_HINT.search(text):
        text = text.translate(_FLAT)
    if _TOUCH.search(text):
        text = _MIXED.sub(lambda m: "".join(PROTOTYPES.get(c, c) for c in m[0]), text)
    return text, places


def _fold(word: str) -> str:
    return word.lower() if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower().replace("ø", "o").replace("ł", "l").replace("ı", "i")


def _is_surname(word: str) -> bool:
    return len(word) > 1 and _fold(word) not in NOT_SURNAMES and any(c.islower() or c.isupper() for c in word)


@cache
def _hints() -> ahocorasick.Automaton:
    """All cue words in one automaton: word -> (kinds, length)."""
    kinds: dict[str, list] = {}
    for word in NAME_CUES:
        kinds.setdefault(word, []).append("name")
    for word in ID_CUES:
        kinds.setdefault(word, []).append("id")
    for k, (words, *_) in enumerate(ADDRESSES):
        for word in words:
            kinds.setdefault(word, []).append(k)
    for word in MAIL_CUES:
        kinds.setdefault(word, []).append("mail")
    automaton = ahocorasick.Automaton()
    for word, kind in kinds.items():
        automaton.add_word(word, (tuple(kind), len(word)))
    automaton.make_automaton()
    return automaton


def hints(text: str) -> dict:
    """kind -> [(start, end)] of the cue words of a text."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    out: dict = {}
    for last, (kind, size) in _hints().iter(low):
        for k in kind:
            out.setdefault(k, []).append((last + 1 - size, last + 1))
    return out


def _starts_word(text: str, at: int) -> bool:
    if not at:
        return True
    a, b = text[at - 1], text[at]
    return not (a.isalnum() and not ("\u3040" <= a <= "\u9fff")) or "\u3040" <= b <= "\u9fff"


def find_names(text: str, hits: dict, given: frozenset[str] = GIVEN_NAMES) -> list[tuple[int, int]]:
    spans = []
    for m in CAPITAL.finditer(text):
        if _fold(m[0]) not in given:
            continue
        after = _DIRECT.match(text, m.end())
        if after and _is_surname(after[1]):
            spans.append((m.start(), after.end()))
            continue
        before = _BEFORE_COMMA.search(text, max(0, m.start() - 40), m.start())
        if before and _is_surname(before[1]) and _fold(before[1]) not in given and _likely_surname(text, before.start(1), m.end()):
            spans.append((before.start(1), m.end()))
    for start, end in hits.get("name", ()):
        m = _CUED.match(text, end) if _starts_word(text, start) else None
        if m and all(_is_surname(w) for w in re.split(r"[ ,]+", m["name"]) if len(w) > 2):
            spans.append(m.span("name"))
    return spans


def _likely_surname(text: str, start: int, end: int) -> bool:
    """Surname, Given stands at a start, after a cue or mark, or before an end; not after a running sentence."""
    head = text[max(0, start - 24) : start]
    return bool(not head.strip() or _FREE_START.search(head) or _FREE_END.match(text, end))


def find_zh_names(text: str, hits: dict, given: frozenset[str] = GIVEN_NAMES) -> list[tuple[int, int]]:
    if not _HAN.search(text):
        return []
    spans = [m.span("name") for p in (ZH_CUED, ZH_CELL) for m in p.finditer(text)]
    for m in ZH_COMPOUND.finditer(text):
        if not ZH_AMBIGUOUS.match(m[0]):
            spans.append(m.span())
    return spans


def find_phones(text: str, hits: dict, given: frozenset[str] = GIVEN_NAMES) -> list[tuple[int, int]]:
    spans = []
    for m in DIGITS.finditer(text):
        s, ext = m[0], EXTENSION.search(m[0])
        core = s[: ext.start()] if ext else s
        core = core.rstrip(" .-/(")
        n = sum(c.isdigit() for c in core)
        if not 7 <= n <= 15 or core.count("(") != core.count(")"):
            continue
        head = text[max(0, m.start() - 32) : m.start()]
        known = any(p.fullmatch(core) for p in PHONE_FORMS)
        if not known and (ext and re.fullmatch(r"\d{3,4}[ \-]\d{3,4}", core, re.A)):
            known = True
        if not known and not re.fullmatch(r"(?:19|20)\d\d[-./]\d\d[-./]\d\d.*|\d+\.\d+|\d{1,3}(?:\.\d{1,3}){3}.*", core, re.A):
            known = bool(_CUE_BEFORE.search(head)) and not re.search(r"\d{4}-\d{4}-\d{4}", core)
        if known and not _BAD_BEFORE.search(head):
            spans.append((m.start(), m.start() + (len(s) if ext else len(core))))
    return spans


def find_ids(text: str, hits: dict, given: frozenset[str] = GIVEN_NAMES) -> list[tuple[int, int]]:
    spans = []
    for start, end in hits.get("id", ()):
        m = ID_TAIL.match(text, end) if _starts_word(text, start) else None
        if m and sum(c.isdigit() for c in m[1]) >= 5:
            spans.append(m.span(1))
    spans += [m.span() for m in ID_BARE.finditer(text)]
    return spans


def find_emails(text: str, hits: dict, given: frozenset[str] = GIVEN_NAMES) -> list[tuple[int, int]]:
    spans, at = [], text.find("@")
    while at >= 0:
        local, domain = _LOCAL_END.search(text, max(0, at - LOCAL_MAX - 1), at), _DOMAIN_START.match(text, at)
        if local and domain:
            spans.append((local.start(), domain.end()))
        at = text.find("@", at + 1)
    for start, end in hits.get("mail", ()):
        for p in (EMAIL_MARKED, EMAIL_SPELLED):
            spans += [m.span() for m in p.finditer(text, max(0, start - LOCAL_MAX - 1), min(len(text), end + DOMAIN_MAX))]
    return spans


def find_addresses(text: str, hits: dict, given: frozenset[str] = GIVEN_NAMES) -> list[tuple[int, int]]:
    spans = []
    for k, (_, before, after, pattern) in enumerate(ADDRESSES):
        for start, end in hits.get(k, ()):
            if (before is None or before.search(text, max(0, start - ADDRESS_MAX), start)) and (after is None or after.match(text, end)):
                spans += [m.span() for m in pattern.finditer(text, max(0, start - ADDRESS_MAX), min(len(text), end + ADDRESS_MAX))]
    return spans


FINDERS = {
    "email": (find_emails,),
    "id-number": (find_ids,),
    "phone": (find_phones,),
    "street-address": (find_addresses,),
    "person-name": (find_names, find_zh_names),
}
_DIGIT = re.compile(r"\d")
_HAN = re.compile("[\u4e00-\u9fff]")


def find(text: str | None, patterns: tuple[str, ...] = tuple(FINDERS), given: frozenset[str] = GIVEN_NAMES) -> list[tuple[int, int, str, str]]:
    """(start, end, pattern, value) of all personal data of a text, in order and without overlap."""
    if not text:
        return []
    plain, places = plain_copy(text)
    found: list[tuple[int, int, str]] = []
    hits = hints(plain)
    for name, finders in FINDERS.items():
        if name not in patterns or (name in ("id-number", "phone", "street-address") and not _DIGIT.search(plain)):
            continue
        spans = sorted({s for f in finders for s in f(plain, hits, given)}, key=lambda s: (s[0], -s[1]))
        taken, last = [], -1
        for a, b in spans:
            if a >= last:
                taken.append((a, b))
                last = b
        if taken:
            found += [(a, b, name) for a, b in taken]
            parts, at = [], 0
            for a, b in taken:  # what is taken is out of sight for later types
                parts += [plain[at:a], "\0" * (b - a)]
                at = b
            plain = "".join(parts) + plain[at:]
    if not found:
        return []
    found.sort()
    source, _ = plain_copy(text)
    out = []
    for a, b, name in found:
        value = source[a:b]
        if places is not None:
            a, b = places[a], places[b - 1] + 1
        out.append((a, b, name, value))
    return out


_MARKER = re.compile(rf"(?i){_AT}|[ \t]*[\[({{<][ \t]*(?:dot|\.|punkt|punto|point|точка)[ \t]*[\])}}>][ \t]*|(?<=\w) (?:at|\(at\)|\[at\]|dot) (?=\w)")
_AT_MARKER = re.compile(r"(?i)[\[({< \t]*(?:at|@|arroba|ät|собака)[\])}> \t]*")
_EXTENSION_WORD = re.compile(r"[ ,]{0,2}(?:ext|x|Durchwahl|poste|ramal|доб|转|分机)\.? ?(?=\d{1,6}$)", re.A)


def canonical(value: str, pattern: str) -> str:
    """One form of a value, whatever its separators: e-mail markers as @ and dot, numbers without separators, names in the order Given Surname."""
    v = unicodedata.normalize("NFKC", value)
    if pattern == "email":
        return _MARKER.sub(lambda m: "@" if _AT_MARKER.fullmatch(m[0]) else ".", v).lower()
    if pattern == "phone":
        number, _, extension = _EXTENSION_WORD.sub(";", v, count=1).partition(";")
        number = re.sub(r"\D", "", re.sub(r"^\(?00(?=[1-9])", "+", number).replace("(0)", "")) if number.lstrip("( ").startswith(("+", "00")) else re.sub(r"\D", "", number)
        return ("+" if v.lstrip("( ").startswith(("+", "00")) else "") + number + (";" + extension if extension else "")
    if pattern == "id-number":
        return re.sub(r"[\W_]", "", v).upper()
    if pattern == "person-name" and "," in v:
        surname, _, given = v.partition(",")
        v = f"{given} {surname}"
    return " ".join(re.sub(r"[^\w'’\-]+", " ", v).lower().split())


def _secret(key: str) -> bytes:
    if not key:
        raise ValueError("a secret key is required")
    return hashlib.sha256(key.encode()).digest()


def link(value: str, pattern: str, key: str) -> str:
    """The permuted canonical value: equal for equal values."""
    plain, k = canonical(value, pattern), _secret(key)
    scheme = scheme_of(plain) if pattern == "id-number" else None
    return permute_valid(plain, scheme, k) if scheme else permute(plain, k, pattern.encode())


def restore(linked: str, pattern: str, key: str, scheme: str | None = None) -> str:
    """The canonical value of a link; scheme is that of its record."""
    return permute_valid(linked, scheme, _secret(key), True) if scheme else permute(linked, _secret(key), pattern.encode(), True)


# Words of a street address that say what its parts are.
_ADDRESS_LABEL = re.compile(
    r"(?i)(?<![^\W_])(?:Street|St|Avenue|Ave|Close|Lane|Ln|Road|Rd|Blvd|Boulevard|Drive|Dr|Court|Ct|Way|Terrace|Square|Place|Crescent|Row|Hill|Parkway|Gardens|Flat|Apt|Unit|Suite|Room|rue|chemin|allée|impasse|quai|route|Calle|Plaza|Avda|Avenida|Paseo|Rua|Praça|ул|улица|проспект|просп|переулок|пер|д|дом|кв|квартира)(?![^\W_])|大道|胡同|[路街巷弄号號室栋楼层]|单元|丁目"
)


def pseudonym(value: str, pattern: str, key: str) -> str:
    """The permuted value in the format found: separators, accents aside, and labels stay."""
    text = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    k = _secret(key)
    where = [i for i, ch in enumerate(text) if ch.isdigit()] if pattern == "phone" else list(range(len(text)))
    labels = {"email": _MARKER, "street-address": _ADDRESS_LABEL}.get(pattern)
    if labels:
        kept = {i for m in labels.finditer(text) for i in range(*m.span())}
        where = [i for i in where if i not in kept]
    if pattern == "id-number":
        at = [i for i, ch in enumerate(text) if ch.isascii() and ch.isalnum()]
        compact = "".join(text[i] for i in at).upper()
        scheme = scheme_of(compact)
        if scheme:
            chars = list(text)
            for i, ch in zip(at, permute_valid(compact, scheme, k)):
                chars[i] = ch
            return "".join(chars)
    return permute(text, k, pattern.encode() + b"|form", where=where)


_LINE_END = re.compile(r"\r\n|\r|\n")


def places(text: str | None, patterns: tuple[str, ...], given: frozenset[str]) -> list[dict]:
    """Line and pattern of each match."""
    spans = find(text, patterns, given)
    if not spans:
        return []
    ends = [m.end() for m in _LINE_END.finditer(text)]
    return [{"line_number": bisect_right(ends, a) + 1, "pattern_name": name, "value": value} for a, _, name, value in spans]


def matches(text: str | None, patterns: tuple[str, ...], key: str, given: frozenset[str] = GIVEN_NAMES) -> list[dict]:
    """The record of each match; the value itself is not in it."""
    out = []
    for m in places(text, patterns, given):
        value, name = m.pop("value"), m["pattern_name"]
        scheme = scheme_of(canonical(value, name)) if name == "id-number" else None
        out.append(m | {"scheme": scheme, "pseudonym": pseudonym(value, name, key), "link": link(value, name, key)})
    return out


def redact(text: str | None, placeholders: dict[str, str]) -> str | None:
    """The text with every match replaced by the placeholder of its type."""
    spans = find(text, tuple(placeholders))
    if not spans:
        return text
    parts, at = [], 0
    for a, b, name, _ in spans:
        parts += [text[at:a], placeholders[name]]
        at = b
    return "".join(parts) + text[at:]


PLACES = "array<struct<line_number:int,pattern_name:string>>"
MATCHES = "array<struct<line_number:int,pattern_name:string,scheme:string,pseudonym:string,link:string>>"


def _types(redact_types: DataFrame) -> dict[str, str]:
    """The types of the table that there is a detector for: no more than those are read."""
    known = redact_types.filter(F.col("pattern_name").isin(*FINDERS) & F.col("placeholder").isNotNull())
    rows = known.groupBy("pattern_name").agg(F.min("placeholder").alias("placeholder")).collect()
    return {r.pattern_name: r.placeholder for r in rows}


def _with_body(pages: DataFrame) -> DataFrame:
    return spread(pages.filter(F.col("body").isNotNull() & (F.col("body") != "")).select("rev_id", "body"), "rev_id")


def find_personal_data(pages: DataFrame, redact_types: DataFrame, given_names: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """(rev_id, line_number, pattern_name): one row for each line of a body and each pattern that occurs in it. given_names are in lower case, without accents."""
    patterns = tuple(_types(redact_types))

    @F.pandas_udf(PLACES)
    def found(body: pd.Series) -> pd.Series:
        keys = ("line_number", "pattern_name")
        return pd.Series([[dict(zip(keys, x)) for x in dict.fromkeys((m["line_number"], m["pattern_name"]) for m in places(b, patterns, given_names))] for b in body])

    return _with_body(pages).select("rev_id", F.explode(found("body")).alias("m")).select("rev_id", "m.*")


def personal_records(pages: DataFrame, redact_types: DataFrame, key: str, given_names: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """(rev_id, line_number, pattern_name, scheme, pseudonym, link): one row for each match of each body. scheme names the numbering scheme that a number is valid in."""
    patterns = tuple(_types(redact_types))
    _secret(key)

    @F.pandas_udf(MATCHES)
    def found(body: pd.Series) -> pd.Series:
        return pd.Series([matches(b, patterns, key, given_names) for b in body])

    return _with_body(pages).select("rev_id", F.explode(found("body")).alias("m")).select("rev_id", "m.*")


def redact_bodies(pages: DataFrame, redact_types: DataFrame) -> DataFrame:
    """(rev_id, body) with placeholders; null and untouched bodies as they are."""
    placeholders = _types(redact_types)

    @F.pandas_udf(T.StringType())
    def cleaned(body: pd.Series) -> pd.Series:
        return pd.Series([redact(b, placeholders) for b in body], dtype=object)

    return spread(pages.select("rev_id", "body"), "rev_id").select("rev_id", cleaned("body").alias("body"))
