"""Candidate segments of personal information and their whole-span features, for many texts at once.

Texts are cut into tokens: runs of letters, runs of digits, single ideographs and single marks. A candidate of
a kind is any span of tokens up to the kind's bound that meets what the kind can't do without: a name has two
or more capitalised words or initials, or an ideograph that is a family name with one or two others; a number
has 7 to 18 digits; an address has words and a number at one of its ends; an e-mail address has a sign or word
for "at" inside. Nothing else is asked of a candidate. Features are small integers, one of each group a
candidate: shapes, lengths, affixes, lists, check digits, neighbours, words before. All of it is columns over
tokens, so a batch of texts costs a few passes over arrays, not a loop over its spans.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterable

import numpy as np
import regex

KINDS = ("email", "phone", "identity_number", "street_address", "name")
#: Bounds of a candidate in tokens, by kind; an e-mail address has those of its standard, in characters.
NAME_TOKENS, HAN_NAME, NUMBER_TOKENS, ADDRESS_TOKENS, HAN_ADDRESS = 10, 4, 20, 16, 24
LOCAL_CHARS, DOMAIN_CHARS = 80, 320  # 64 and 255, with room for marks written out

# ---------------------------------------------------------------- word lists: common knowledge, stated as fixed values
#: Words and parts of words for streets; a word may follow the name, precede it, or end it.
STREET_AFTER = "street st road rd avenue ave lane ln drive dr court ct terrace ter place pl square sq boulevard blvd way close crescent cres parkway pkwy trail walk row hill gardens gdns grove highway hwy circle cir mews quay alley parade plaza wharf yard rise vale view".split()
STREET_BEFORE = "rue avenue av boulevard bd bld place pl allée allee chemin quai impasse route cours ruelle sentier square calle c avenida avda paseo plaza camino ronda travesía carrera carrera callejón callejon via viale piazza corso vicolo largo strada rua travessa praça estrada alameda ulica ul aleja carrer ulitsa prospekt улица ул проспект пр переулок пер шоссе набережная utca út".split()
STREET_END = "straße strasse str weg gasse allee platz ring damm ufer steig chaussee graben stieg pfad zeile markt hof berg tor brücke straat laan plein kade gracht dreef gatan vägen väg gata vej vejen gade gaden katu tie veien gate".split()
STREET_LEAD = "am im an den der auf dem in zum zur hinter unter vor bei op aan de het 't".split()
HAN_STREET = "街道路巷弄里胡同段"
SIDES = "n s e w ne nw se sw north south east west".split()
DOOR_WORDS = "n nº n° no nr núm num numero número nummer numéro".split()
SUFFIXES = "bis ter quater a b c d e f g h".split()
PARTICLES = "van von der den de la del di da du des della delle degli dello los las das le ter ten dos das do el al bin ibn zu zur af av y e st".split()
TITLES = "dr mr mrs ms miss prof professor herr herrn frau mme mlle m madame monsieur sr sra srta señor señora don doña sir dame rev fr sig dott mx mevrouw meneer".split()
#: Words of grammar and time that begin sentences and are no names.
GRAMMAR = frozenset(
    "the a an this that these those our your his her their its my we they he she it i you if in on at of for from to by with and or but not no nor so as is are was were be been am do does did has have had will would can could may might must shall should let lets please see also each every all any some none when while where what which who whom why how before after given although though because since until unless once despite between during over under above below into onto out up down off again further then than there here now just only very more most other such both few own same too yes nothing else never always often still even "
    "der die das ein eine einen einem einer im den dem des und oder nicht kein keine wir sie er es ich ihr unser unsere mit auf bei nach vor für ist sind war waren wird wurde hat haben wenn weil dass als aber auch nur noch schon sehr bitte fragen laut beim vom zum zur "
    "le la les un une des du et ou ne pas nous vous ils elle elles je il on est sont était ont avec dans sur pour par plus moins quand car mais donc ce cette ces nos vos leur selon depuis après avant bien "
    "el los las unos unas y o no nosotros ellos ella yo es son era con en por para más menos cuando pero este esta estos estas su sus según desde tras antes como "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo".split()
)
#: Words of things, bodies and places that follow or hold a name without being a person's.
THINGS = frozenset(
    "street road avenue lane drive court square place terrace boulevard bridge river lake valley park island mountain station airport port school college university institute academy hospital church museum library theatre hotel inn house hall tower center centre city town village county state district office department ministry council committee board agency bureau bank group company corporation corp inc ltd llc plc gmbh ag sa foundation society association union club team league cup award prize act law rule code theorem lemma method algorithm model test trial study report review paper book journal magazine times post news press edition series volume chapter section table figure page index list form note plan project program programme system server service suite software platform network cluster protocol format engine index build release version run job batch queue task phase stage unit line gate dock room floor building block wing conference workshop summit festival day week month year war peace street view order invoice number account".split()
)
#: Words before numbers of other kinds, numbers of telephones and of persons, and before names and addresses.
NOISE = frozenset("part ticket build offset run version ver v no nr row rows n id key serial invoice order ref reference batch lot item sku code port line page section chapter table figure room cell hash commit revision rev step epoch seed size count total sum bytes block sector isbn issn doi account iban bestellnummer rechnung commande facture pedido factura tracking case issue bug job node rack bin slot index range pid uid time timestamp date".split())
PHONE_WORDS = frozenset("tel telephone phone fon telefon téléphone telefono teléfono mobil mobile cell handy call calling ring dial fax hotline text sms whatsapp anrufen anruf unter erreichbar appeler appelez joindre llamar llame ext extension contact backup".split())
ID_WORDS = frozenset("ssn sin nino ni social security insurance national identity identification passport idnr steuer steuerid steueridentifikationsnummer identifikationsnummer taxpayer tax id card resident personal personalausweis ausweis dossier formulario antrag formular form badge nif dni curp".split())
NAME_WORDS = frozenset("by from owner attention attn contact ping cc name named called author reviewer reviewed signed dear hi hello regards sincerely thanks cheers manager engineer director nurse teacher colleague neighbour sister brother mother father wife husband met told asked called bitte hd kollege kollegin chef herrn selon joindre auteur responsable nom según avisar nombre autor encargado according".split())
PLACE_WORDS = frozenset("address deliver delivered delivery courier left send sent ship shipped shipping lives live living resides located home office at to visit mail parcel anschrift adresse wohnt wohnhaft lieferung an envoyer habite domicile domicilio dirección enviar vive entrega situé apt flat unit suite floor".split())
HAN_CUES = {"phone": "电话 手机 致电 拨打 拨 座机 热线 联系方式 打".split(), "id": "身份证号码 身份证号 身份证 证件号 证件 证号".split(), "name": "姓名 收件人 联系人 抄送 负责人 申请人 经办人 同事 客户 由 请 找 据 给 向 与 和 问 叫".split(), "place": "地址 住址 寄往 寄到 寄至 送到 送往 住在 家住 位于 发往 地点 在 到".split()}
#: Frequent and some rarer family names of one ideograph, and of two.
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳管柴蒙鲍华喻祁房解牟屈滕卫岑嵇郦蔺柏虞闻荀"
HAN_FAMILY_2 = "欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐 司徒 夏侯 端木 南宫 长孙 宇文 轩辕 独孤".split()
#: Ideographs of grammar, rare inside given names; words after a person; forms of address.
HAN_GRAMMAR = "的了是在不有我他她它们这那个为和与就都而及或被把从到对于可以要没也很再又还只能会上下前后中里外第每各种些几单位数据点位层高度时间方向果结何谁么哪吗呢吧啊请由给向找问"
HAN_AFTER = "收昨今已刚曾说称问答负认提交写来去先女老工将表回打拒建"
HAN_VERBS = "寄送住位发往在到于家址是从"
#: Given and family names common in several countries.
COMMON_GIVEN = "james john robert michael william david richard joseph thomas mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna maria laura peter paul george martin daniel mark steven andrew emma olivia sophie hans klaus jürgen wolfgang stefan andreas ursula monika petra sabine jean pierre michel françois philippe marie isabelle nathalie camille josé juan carlos luis miguel antonio carmen dolores pilar ana giovanni marco giulia francesca joão pedro ivan sergei dmitri olga natalia anastasia piotr katarzyna lars erik ingrid astrid mohammed ahmed ali fatima aisha omar rajesh priya amit sunita arjun deepak wei ming li hiroshi yuki kenji akiko min-jun ji-woo nguyen kwame amina chidi иван петр пётр сергей анна мария ольга дмитрий елена наталья".split()
COMMON_FAMILY = "smith johnson williams brown jones miller davis wilson anderson taylor moore jackson martin lee thompson white harris clark lewis robinson walker hall young king wright scott green baker adams müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann dubois durand leroy moreau laurent lefebvre garcía garcia lópez lopez martínez rodríguez hernández gonzález pérez sánchez rossi russo ferrari bianchi silva santos oliveira souza ivanov petrov sidorov smirnov kowalski nowak hansen johansson larsen nielsen khan ahmed hassan kumar sharma singh patel gupta chen wang zhang liu tanaka suzuki sato yamamoto kim park nguyen tran okafor mensah иванов иванова петров петрова сидоров смирнов кузнецов попов".split()

SIGN_ROLES = ("phone", "id", "name", "place", "noise")
_ROLE_WORDS = {"phone": PHONE_WORDS, "id": ID_WORDS, "name": NAME_WORDS, "place": PLACE_WORDS, "noise": NOISE}
# bits of a word
TITLE, GRAM, THING, PARTICLE, AFTER, BEFORE, END, LEAD, SIDE, SUFFIX, DOOR = (1 << i for i in range(11))
CUE = {r: 1 << (11 + i) for i, r in enumerate(SIGN_ROLES)}


# ---------------------------------------------------------------- characters
#: One character to one, so positions stay: full-width forms, special spaces, hyphens and apostrophes.
FLAT = {0xFF01 + i: 0x21 + i for i in range(94)} | {c: 0x20 for c in (0x3000, 0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F)} | {c: 0x2D for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)} | {0x2019: 0x27}
SPACE, LINE, DIGIT, UPPER, LOWER, HAN, LETTER, MARK = range(8)


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(plain character, class) of every character."""
    flat = np.arange(0x110000, dtype=np.uint32)
    for c, d in FLAT.items():
        flat[c] = d
    kinds = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Mn": LOWER, "Mc": LOWER, "Me": LOWER, "Lm": LETTER, "Lo": LETTER, "Zs": SPACE, "Cc": SPACE, "Cf": SPACE}
    group = np.full(0x110000, MARK, np.uint8)
    for c in range(0x32000):
        group[c] = kinds.get(unicodedata.category(chr(c)), MARK)
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x323B0)):
        group[a:b] = HAN
    group[0x30:0x3A] = DIGIT
    group[[0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029]] = LINE
    for c, d in FLAT.items():
        group[c] = group[d]
    return flat, group


# ---------------------------------------------------------------- words
class Lexicon(dict):
    """Row number of every distinct word met; its features are made once. ``vocabulary`` gives 1 to words frequent in lower case, 2 to those frequent only or mostly with a capital."""

    COLUMNS = 7  # bits, shape, length, given, family, vocabulary, listed street ending

    def __init__(self, parts: Iterable[tuple[str, str]], vocabulary: dict[str, int] | None = None):
        super().__init__()
        self.vocabulary = vocabulary or {}
        self.given, self.family, self.han_family = set(COMMON_GIVEN), set(COMMON_FAMILY), set(HAN_FAMILY)
        own: tuple[list[str], list[str]] = ([], [])
        for part, kind in parts:
            if not part:
                continue
            words = [w for w in regex.split(r"[\s'’\-]+", part.lower()) if w and w not in PARTICLES and len(w) > 1 or "一" <= w <= "鿿"]
            for w in words:
                if "一" <= w[0] <= "鿿":
                    if kind == "family" and len(w) == 1:
                        self.han_family.add(w)
                    continue
                (self.given if kind == "given" else self.family).add(w)
                own[kind != "given"].append(w)
        common = lambda words, cut: {x for x, n in Counter(x for w in set(words) for x in cut(w)).items() if n >= 3}
        ends = lambda w: [w[-k:] for k in range(3, 6) if len(w) > k + 1]
        starts = lambda w: [w[:k] for k in range(3, 6) if len(w) > k + 1]
        self.ends, self.starts = [common(w, ends) for w in own], [common(w, starts) for w in own]
        self.rows: list[tuple[int, ...]] = []
        self.table = np.zeros((0, self.COLUMNS), np.int32)

    def _name(self, w: str, which: int) -> int:
        """0 unlike the listed names, 1 a common beginning or ending, 2 both, 3 listed."""
        if w in (self.family if which else self.given):
            return 3
        return int(any(w[-k:] in self.ends[which] for k in range(5, 2, -1))) + int(any(w[:k] in self.starts[which] for k in range(5, 2, -1)))

    def __missing__(self, word: str) -> int:
        w = unicodedata.normalize("NFKC", word).lower()
        bits = 0
        for bit, words in ((TITLE, TITLES), (GRAM, GRAMMAR), (THING, THINGS), (PARTICLE, PARTICLES), (AFTER, STREET_AFTER), (BEFORE, STREET_BEFORE), (LEAD, STREET_LEAD), (SIDE, SIDES), (SUFFIX, SUFFIXES), (DOOR, DOOR_WORDS)):
            if w in words:
                bits |= bit
        if any(w.endswith(e) and (len(w) > len(e) + 2 or w == e) for e in STREET_END):
            bits |= END
        for role, words in _ROLE_WORDS.items():
            if w in words:
                bits |= CUE[role]
        shape = 3 if len(word) == 1 and word.isupper() else 4 if len(word) == 1 and word.islower() else 2 if word.isupper() else 0 if word.islower() else 1 if word[0].isupper() and word[1:].islower() else 5 if word[0].isupper() else 6
        row = (bits, shape, min(len(w), 12), self._name(w, 0), self._name(w, 1), self.vocabulary.get(w, 0), 0)
        self[word] = at = len(self.rows)
        self.rows.append(row)
        return at

    def columns(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.rows) > len(self.table):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.int32)])
        return self.table[at]


def word_classes(tokens: Iterable[tuple[bytes, int]]) -> dict[str, int]:
    """What a public vocabulary says about capitals: of a word that is one token after a space, 1 if its lower case comes first, 2 if its capitalised form does."""
    rank: dict[str, list[int]] = {}
    for raw, n in tokens:
        try:
            t = raw.decode()
        except UnicodeDecodeError:
            continue
        if len(t) > 3 and t[0] == " " and t[1:].isalpha() and (t[1:].islower() or t[2:].islower()):
            rank.setdefault(t[1:].lower(), [1 << 30, 1 << 30])[t[1].isupper()] = n
    return {w: 1 if a < b else 2 for w, (a, b) in rank.items()}


# ---------------------------------------------------------------- candidates
class Spans:
    """Candidates of one batch of texts, as columns: text, start, end (characters of the text), kind, token bounds, features."""

    #: Groups of features by kind, and how many values each may take.
    SIZES: dict[str, list[int]] = {"email": [8, 64, 64, 4, 12, 16, 8], "number": [20, 4096, 8, 16, 64, 64, 8, 8, 8, 8, 16, 8, 64, 48, 16, 192], "street_address": [256, 8, 64, 64, 72, 8, 64, 48, 24, 72, 16], "name": [256, 32, 32, 32, 32, 128, 64, 64, 64, 64, 16, 128, 160, 72, 64, 16, 136]}

    def __init__(self, texts: list[str], lex: Lexicon):
        flat, group = tables()
        self.lex = lex
        self.big = big = "\n".join(texts) + "\n"
        raw = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.raw = raw
        plain = flat[raw]
        g = group[raw]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        kind = np.array([0, 1, 2, 3, 3, 4, 3, 5], np.uint8)[g]  # space, line, digits, word, ideograph, mark
        begins = np.ones(len(raw), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1) | (kind[1:] >= 4)
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        keep = kind[starts] != 0
        pad = lambda a, v: np.concatenate([[v], a, [v] * 3])
        self.s, self.e = pad(starts[keep], 0), pad(ends[keep], 0)
        self.k = pad(kind[starts[keep]], 1).astype(np.int8)
        self.c = pad(plain[starts[keep]], 10)
        self.s[-3:] = self.e[-3:] = len(raw)
        n = self.n = len(self.s)
        gap = np.zeros(n, np.int64)
        gap[1:] = self.s[1:] - self.e[:-1]
        self.gap = np.clip(gap, 0, 3)  # spaces before a token
        self.long = self.e - self.s
        words = np.flatnonzero(self.k == 3)
        cols = lex.columns([big[a:b] for a, b in zip(self.s[words].tolist(), self.e[words].tolist())])
        self.w = np.zeros((Lexicon.COLUMNS, n), np.int32)
        self.w[:, words] = cols.T
        self.bits, self.shape, self.wlen, self.given, self.family, self.vocab, _ = self.w
        self.word = self.k == 3
        self.num = self.k == 2
        self.han = self.k == 4
        cap = self.word & np.isin(self.shape, (1, 2, 3, 5))
        self.cap = cap
        self.line = np.maximum.accumulate(np.where(self.k == 1, np.arange(n), 0))  # last line break at or before
        self.total = np.concatenate([[0], np.cumsum(np.where(self.num, self.long, 0))])  # digits before a token
        self._around()
        self._cues(raw)
        self.parts: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self._names()
        self._han_names()
        self._numbers()
        self._addresses()
        self._emails()
        order = [(k, i, j, s, e, f) for k, i, j, s, e, f in self.parts if len(i)]
        self.kind = np.concatenate([np.full(len(i), KINDS.index(k), np.int8) for k, i, *_ in order] or [np.zeros(0, np.int8)])
        self.i = np.concatenate([p[1] for p in order] or [np.zeros(0, np.int64)])
        self.j = np.concatenate([p[2] for p in order] or [np.zeros(0, np.int64)])
        start = np.concatenate([p[3] for p in order] or [np.zeros(0, np.int64)])
        end = np.concatenate([p[4] for p in order] or [np.zeros(0, np.int64)])
        self.features = [(k, f) for k, *_, f in order]
        self.text = np.searchsorted(self.offsets, start, side="right") - 1
        self.start, self.end = start - self.offsets[self.text], end - self.offsets[self.text]

    # -------------------------------------------------------- what stands around
    def _around(self) -> None:
        """A code of each token as a neighbour: its sort, and whether it is glued to what follows or precedes."""
        code = np.zeros(self.n, np.int64)
        code[self.word] = np.where(self.cap[self.word], 2, 1)
        code[self.num], code[self.han] = 3, 4
        for n, marks in enumerate((":：", "=", "([{<（《【", ",;，；、", ".!?。！？…", "\"“”'‘«»`", "-—–", "/\\", "@", "|", "_+%#&*~^", ")]}>）》】"), 5):
            code[(self.k == 5) & np.isin(self.c, [ord(x) for x in marks])] = n
        code[(self.k == 5) & (code == 0)] = 17
        self.code = code
        nxt = np.append(self.gap[1:], 1)
        self.before = np.roll(code, 1) * 3 + np.clip(self.gap, 0, 2)  # of the token before t, by t
        self.after = np.roll(code, -1) * 3 + np.clip(nxt, 0, 2)
        self.next_gap = nxt

    def _cues(self, raw: np.ndarray) -> None:
        """For each sort of cue word the last token with it, by token."""
        at = np.arange(self.n)
        self.near = {}
        token_of = None
        for role in SIGN_ROLES:
            hit = (self.bits & CUE[role]) != 0
            if role in HAN_CUES and self.han.any():
                if token_of is None:
                    token_of = np.zeros(len(raw) + 1, np.int64)
                    token_of[self.s[1:-3]] = at[1:-3]
                for m in regex.finditer("|".join(HAN_CUES[role]), self.big):
                    hit[token_of[m.end() - 1]] = True
            last = np.maximum.accumulate(np.where(hit, at, -1))
            self.near[role] = np.where(last >= self.line, last, -1)

    def cue(self, role: str, i: np.ndarray) -> np.ndarray:
        """How far before token ``i`` on its line the cue stands: 0 not at all, 1 just before, to 5."""
        d = i - self.near[role][i - 1]
        return np.where((self.near[role][i - 1] < 0) | (d > 12), 0, np.select([d <= 1, d <= 2, d <= 4, d <= 7], [1, 2, 3, 4], 5))

    def all_cues(self, i: np.ndarray) -> np.ndarray:
        """Which cues stand near: a bit each."""
        return sum((self.cue(r, i) > 0).astype(np.int64) << b for b, r in enumerate(SIGN_ROLES))

    @staticmethod
    def sums(flag: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flag)])

    def within(self, link: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """All spans of ``least`` to ``most`` tokens from a start to an end token, with a link between any two neighbours."""
        run = self.sums(~link)[:-1]  # the same number along a run of links
        first = np.flatnonzero(starts)
        out_i, out_j = [], []
        for size in range(least, most + 1):
            j = first + size - 1
            first, j = first[j < self.n - 3], j[j < self.n - 3]
            alive = run[first] == run[j]
            first, j = first[alive], j[alive]
            if not len(first):
                break
            good = ends[j]
            out_i.append(first[good])
            out_j.append(j[good])
        return np.concatenate(out_i or [first[:0]]), np.concatenate(out_j or [first[:0]])

    def add(self, kind: str, i: np.ndarray, j: np.ndarray, features: list[np.ndarray], group: str | None = None, start: np.ndarray | None = None, end: np.ndarray | None = None) -> None:
        sizes = self.SIZES[group or kind]
        cols = np.stack([np.minimum(np.maximum(f, 0), size - 1) for f, size in zip(features, sizes)], 1) if len(i) else np.zeros((0, len(sizes)), np.int64)
        assert cols.shape[1] == len(sizes)
        self.parts.append((kind, i, j, self.s[i] if start is None else start, self.e[j] if end is None else end, cols))

    # -------------------------------------------------------- names
    def _names(self) -> None:
        c, gap, word, cap = self.c, self.next_gap, self.word, self.cap
        part = word & ((self.bits & PARTICLE) != 0)
        nxt = lambda a: np.append(a[1:], a[:1] & False)
        prev = lambda a: np.concatenate([a[:1] & False, a[:-1]])
        dot, comma, hyphen, quote = ((self.k == 5) & (c == ord(x)) for x in ".,-'")
        joins = (hyphen | quote) & prev(word) & (self.gap == 0) & nxt(cap | (word & (self.wlen > 1))) & (gap == 0)
        initial = word & (self.shape == 3) & ~nxt(joins)
        apostrophe = word & (self.wlen == 1) & nxt(joins & quote)
        namely = cap | part | apostrophe
        after_initial = dot & prev(initial) & (self.gap == 0)
        spaced = (gap >= 1) & (gap <= 2)
        link = namely & nxt(namely) & spaced
        link |= initial & nxt(after_initial)
        link |= after_initial & nxt(namely) & (gap <= 1)
        link |= after_initial & nxt(initial) & (gap <= 1)
        link |= namely & nxt(joins) & (gap == 0)
        link |= word & (self.wlen == 1) & nxt(joins & quote) & (gap == 0)
        link |= joins & nxt(cap) & (gap == 0)
        link |= cap & nxt(comma) & (gap == 0)
        link |= comma & prev(cap) & nxt(namely) & (gap == 1)
        starts = cap | (part & ~cap & ((nxt(namely) & spaced) | nxt(joins))) | apostrophe
        starts &= ~prev(joins)
        ends = (cap & ~initial) | after_initial
        ends &= ~nxt(joins)
        heads = cap & ~(prev(joins) & prev(prev(cap)))  # a compound is one word
        i, j = self.within(link, starts, ends, NAME_TOKENS, 2)
        words, commas = self.sums(heads), self.sums(comma)
        k = words[j + 1] - words[i]
        n_comma = commas[j + 1] - commas[i]
        long_words = self.sums(cap & (self.wlen > 1))
        good = (k >= 2) & (n_comma <= 1) & (long_words[j + 1] - long_words[i] >= 1) & (k <= 6)
        last_dot = after_initial[j]
        good &= ~last_dot | (n_comma == 1) | (k == 2) | (k == 3)
        i, j, k, n_comma, last_dot = (x[good] for x in (i, j, k, n_comma, last_dot))
        at = np.arange(self.n)
        # the first and last word of the span that could be a given or family name; those by the comma
        next_cap = np.minimum.accumulate(np.where(cap, at, self.n)[::-1])[::-1]
        last_cap = np.maximum.accumulate(np.where(cap, at, 0))
        a, b = next_cap[i], last_cap[j]
        # the name of a compound counts by its best part
        def best(col: np.ndarray, t: np.ndarray, way: int) -> np.ndarray:
            out = col[t]
            other = np.clip(t + 2 * way, 0, self.n - 1)
            mark = np.clip(t + way, 0, self.n - 1)
            return np.where(joins[mark], np.maximum(out, col[other]), out)

        given_a, family_a = best(self.given, a, 1), best(self.family, a, 1)
        given_b, family_b = best(self.given, b, -1), best(self.family, b, -1)
        last_comma = np.maximum.accumulate(np.where(comma, at, 0))[j]
        mid = np.where(n_comma > 0, next_cap[np.minimum(last_comma + 1, self.n - 1)], b)
        before_mid = np.where(n_comma > 0, last_cap[np.maximum(last_comma - 1, 0)], a)
        is_initial_a, is_initial_b = initial[a], initial[b]
        va, vb = np.where(is_initial_a, 3, self.vocab[a]), np.where(is_initial_b, 3, self.vocab[b])
        bit = lambda t, m: ((self.bits[t] & m) != 0).astype(np.int64)
        parts, stops, common, upper, titles, initials = self.sums(part), self.sums(cap & ((self.bits & GRAM) != 0)), self.sums(cap & (self.vocab == 1)), self.sums(cap & (self.shape == 2)), self.sums(cap & (self.shape == 1)), self.sums(initial)
        known = self.sums(cap & ((self.given == 3) | (self.family == 3)))
        some = lambda x: (x[j + 1] - x[i])
        near_name = self.cue("name", i)
        p = i - 1
        title = bit(p, TITLE) | ((c[p] == ord(".")) & (bit(np.maximum(p - 1, 0), TITLE) > 0) & (self.s[i] - self.e[p] <= 1)).astype(np.int64)
        article = ((self.bits[p] & GRAM) != 0) & np.isin(self.wlen[p], (1, 2, 3)) & (self.shape[p] <= 4) & ((self.bits[p] & CUE["name"]) == 0) & (self.k[p] == 3)
        left_more = link[p] & (p > 0)
        right_more = link[j]
        q = j + 1
        q2 = np.minimum(q + 1, self.n - 1)
        right_word = np.where(self.word[q], 1 + cap[q], 0) + 3 * bit(q, THING)
        rows_all_upper = np.where(some(titles) == 0, np.where(some(upper) >= 2, 2, 1), np.where(some(upper) > 0, np.where(self.shape[b] == 2, 3, 4), 0))
        form = np.minimum(k, 5) + 6 * n_comma + 12 * np.minimum(some(parts), 1) + 24 * np.minimum(some(initials), 2) + 72 * last_dot
        self.add(
            "name", i, j,
            [
                form,
                np.where(is_initial_a, 16, given_a + 4 * va),
                np.where(is_initial_b, 16, family_b + 4 * vb),
                np.where(n_comma > 0, 16, family_a + 4 * given_b),
                np.where(n_comma > 0, self.family[before_mid] + 4 * np.where(initial[mid], 4, self.given[mid]), 20),
                (given_a + 4 * family_b) * (n_comma == 0) + 16 * is_initial_a + 32 * (n_comma > 0),
                bit(a, GRAM) + 2 * bit(a, THING) + 4 * bit(a, TITLE) + 8 * bit(a, NOISE_BIT) + 16 * (a != i),
                bit(b, GRAM) + 2 * bit(b, THING) + 4 * bit(b, AFTER | END) + 8 * bit(b, NOISE_BIT),
                self.before[i],
                self.after[j],
                near_name,
                title + 2 * article + 4 * left_more + 8 * (left_more & cap[p]) + 16 * (left_more & (bit(p, GRAM) > 0)) + 32 * (bit(p, PARTICLE) > 0),
                right_more + 2 * right_word + 16 * np.where(right_more, 1 + np.minimum(self.family[np.minimum(next_cap[q], self.n - 1)], 3), 0),
                np.minimum(some(stops), 3) + 4 * np.minimum(some(common), 3) + 16 * np.minimum(some(known), 3),
                va + 4 * vb + 16 * (title | (near_name > 0) & (near_name <= 2)) ,
                rows_all_upper,
                np.minimum(self.wlen[a], 7) + 8 * np.minimum(self.wlen[b], 7) + 64 * (self.code[q2] == 2),
            ],
        )

    # -------------------------------------------------------- names of ideographs
    def _han_names(self) -> None:
        if not self.han.any():
            return
        at = np.flatnonzero(self.han)
        family = np.zeros(self.n, bool)
        family[at] = np.isin(self.c[at], [ord(x) for x in self.lex.han_family])
        pairs = {(ord(a), ord(b)) for a, b in HAN_FAMILY_2}
        two = np.zeros(self.n, bool)
        first = np.isin(self.c, [a for a, _ in pairs])
        for t in np.flatnonzero(first & self.han).tolist():
            two[t] = (int(self.c[t]), int(self.c[t + 1])) in pairs
        link = self.han & np.append(self.han[1:], False) & (self.next_gap == 0)
        i, j = self.within(link, family | two, self.han, HAN_NAME, 2)
        size = j - i + 1
        good = np.where(two[i], size >= 3, size <= 3)
        i, j, size = i[good], j[good], size[good]
        # cued words or clauses end just before
        cue = self.cue("name", i)
        grammar = np.zeros(self.n, bool)
        grammar[at] = np.isin(self.c[at], [ord(x) for x in HAN_GRAMMAR])
        inside = self.sums(grammar)
        odd = inside[j + 1] - inside[i + 1 + two[i]]
        after, verbs = np.isin(self.c, [ord(x) for x in HAN_AFTER]), np.isin(self.c, [ord(x) for x in HAN_VERBS])
        q = j + 1
        frequent = np.isin(self.c[i], [ord(x) for x in HAN_FAMILY[:60]])
        open_left, open_right = ~self.han[i - 1], ~self.han[q]
        zero = np.zeros(len(i), np.int64)
        ctx = np.select([cue == 1, open_left], [1, 2], 0)
        nxt = np.select([after[q] & self.han[q], grammar[q] & self.han[q], open_right], [1, 2, 3], 0)
        self.add(
            "name", i, j,
            [
                150 + size + 5 * two[i] + 10 * np.minimum(odd, 2),
                17 + ctx + 3 * nxt,
                17 + ctx,
                17 + nxt,
                21 + np.minimum(odd, 2) + 3 * (ctx == 1),
                70 + size + 5 * ctx,
                32 + ctx + 3 * (size == 2) + 6 * np.minimum(odd, 1),
                32 + nxt + 4 * (size == 2) + 8 * np.minimum(odd, 1),
                np.where(self.before[i] // 3 == 4, 61, self.before[i]),
                self.after[j],
                8 + cue,
                zero + 70 + frequent + 2 * ctx + 6 * np.minimum(nxt, 1),
                zero + 96 + nxt + 4 * ctx + 12 * np.minimum(odd, 1) + 24 * (size == 2),
                zero + 64, zero + 63, zero + 10 + frequent, zero + 130,
            ],
        )

    # -------------------------------------------------------- numbers of telephones and of persons
    def _numbers(self) -> None:
        c, gap = self.c, self.next_gap
        sep = (self.k == 5) & np.isin(c, [ord(x) for x in "+().-/·"])
        inner = self.num | sep
        nxt = lambda a: np.append(a[1:], False)
        prev = lambda a: np.concatenate([[False], a[:-1]])
        letter = self.word & (self.long == 1)
        cross = letter & np.isin(c, [ord(x) for x in "xX"]) & prev(self.num) & (self.gap <= 1)
        link = inner & nxt(inner | cross) & (gap <= 1)
        starts = self.num | (sep & np.isin(c, [ord("+"), ord("(")]) & (nxt(self.num) | nxt(sep)))
        i, j = self.within(link, starts, self.num | cross, NUMBER_TOKENS)
        digits = self.total[j + 1] - self.total[i]
        good = (digits >= 7) & (digits <= 18)
        self._number_features(i[good], j[good], digits[good], cross, link, False)
        # two letters, six digits, a letter
        pair = self.word & (self.long == 2)
        last = letter & np.isin(c, [ord(x) for x in "abcdABCD"])
        hyphen = (self.k == 5) & (c == ord("-"))
        body = self.num & (self.long <= 6)
        link2 = (pair | body | hyphen) & nxt(body | hyphen | last) & (gap <= 1)
        i, j = self.within(link2, pair & (nxt(body) | nxt(hyphen)), last, 11, 3)
        digits = self.total[j + 1] - self.total[i]
        good = digits == 6
        self._number_features(i[good], j[good], digits[good], cross, link2, True)

    def _number_features(self, i, j, digits, cross, link, lettered: bool) -> None:
        c, flat = self.c, tables()[0]
        parts = self.sums(self.num)
        groups = parts[j + 1] - parts[i]
        at = np.flatnonzero(self.num)
        where = parts  # index into ``at`` of the first number at or after a token
        sig = np.zeros(len(i), np.int64)
        size_of = lambda g: self.long[at[np.minimum(where[i] + g, len(at) - 1)]] if len(at) else np.zeros(len(i), np.int64)
        for g in range(8):
            sig = np.where(groups > g, (sig * 20 + np.minimum(size_of(g), 18) + 1) % 4093, sig)
        count = lambda m: (lambda x: x[j + 1] - x[i])(self.sums((self.k == 5) & np.isin(c, [ord(x) for x in m])))
        spaces = self.sums(self.gap > 0)
        spaces = spaces[j + 1] - spaces[i + 1]
        hy, dot, slash, paren = count("-") > 0, count(".·") > 0, count("/") > 0, count("()") > 0
        kinds = hy.astype(int) + dot + slash + (spaces > 0)
        sepa = np.select([kinds > 1, hy, dot, slash, spaces > 0], [5, 2, 3, 4, 1], 0)
        first = at[np.minimum(where[i], max(len(at) - 1, 0))] if len(at) else i
        d1 = c[first] - 48 if len(at) else digits
        two = np.where(self.long[first] >= 2, 1, 0)
        second_char = np.zeros(len(i), np.int64)
        raw = self.raw
        if len(i):
            second_char = np.where(two > 0, flat[raw[np.minimum(self.s[first] + 1, len(raw) - 1)]].astype(np.int64) - 48, 10)
        plus = c[i] == ord("+")
        opened = c[i] == ord("(")
        lead = np.select([plus, opened & (d1 == 0), opened, (d1 == 0) & (second_char == 0), d1 == 0, d1 == 1], [1, 3, 2, 4, 5, 6], 7)
        land = np.where(plus | ((d1 == 0) & (second_char == 0)), np.minimum(self.long[first], 3) + 4 * (d1 % 10), 0)
        # what the digits say: dates, addresses of machines, check digits
        check = 1 + 8 * cross[j].astype(np.int64)
        for row in np.flatnonzero(np.isin(digits + cross[j], (9, 11, 18))).tolist():
            written = self.big[self.s[i[row]] : self.e[j[row]]]
            check[row] = _check("".join(x for x in written.translate(FLAT) if "0" <= x <= "9"), bool(cross[j[row]]))
        if lettered:
            names = [self.big[a:b].upper() for a, b in zip(self.s[i].tolist(), self.e[i].tolist())]
            check = 10 + np.array([(x == "QQ") + 2 * (x[0] not in "DFIQUV" and x[1] not in "DFIQUVO" and x.isascii()) for x in names], np.int64) if len(i) else digits
        g1, g2 = size_of(0), size_of(1)
        date = (groups == 3) & ((g1 == 4) & np.isin(d1, (1, 2)) & (sepa >= 2)) | (groups >= 3) & (g1 == 4) & (d1 == 2) & (g2 == 2)
        machine = (groups >= 4) & (sepa == 3) & (digits <= 12) & (g1 <= 3)
        decimal = (groups == 2) & (sepa == 3) & (g1 <= 3)
        odd = date + 2 * machine + 4 * decimal
        phone, ident, noise = self.cue("phone", i), self.cue("id", i), self.cue("noise", i)
        left_more = link[i - 1] & (i > 1)
        right_more = link[j]
        more = left_more + 2 * right_more + 4 * (left_more & (self.gap[i] == 0)) + 8 * (right_more & (self.next_gap[j] == 0))
        any_cue = np.select([(ident > 0) & ((phone == 0) | (ident < phone)), phone > 0, noise > 0], [2, 1, 3], 0)
        second = at[np.minimum(where[i] + 1, max(len(at) - 1, 0))] if len(at) else i
        features = [
            digits, np.where(lettered, 4094, sig), sepa, lead + 8 * paren, self.before[i], self.after[j], phone, ident, noise, odd, check, np.minimum(groups, 7),
            lead + 8 * np.where(groups > 1, 1 + (np.isin(c[second], [ord("0"), ord("1")])).astype(np.int64), 0) + 24 * np.minimum(any_cue, 1), land, more, digits + 20 * any_cue + 80 * (sepa == 0) * (any_cue < 3),
        ]
        if not lettered:
            self.add("phone", i, j, features, "number")
        self.add("identity_number", i, j, features, "number")

    # -------------------------------------------------------- street addresses
    def _addresses(self) -> None:
        c, gap, word, cap = self.c, self.next_gap, self.word, self.cap
        nxt = lambda a: np.append(a[1:], False)
        prev = lambda a: np.concatenate([[False], a[:-1]])
        bit = lambda m: (self.bits & m) != 0
        num = self.num & (self.long <= 5)
        mark = (self.k == 5) & np.isin(c, [ord(x) for x in ".,'-/º°ª#№"])
        small = word & ~cap & (bit(PARTICLE | BEFORE | LEAD | SUFFIX | SIDE | END | DOOR) | np.isin(self.wlen, (1,)))
        small |= word & ~cap & (self.bits == 0) & prev(mark & (c == ord("'"))) & (self.gap == 0)
        inner = cap | small | num | mark
        link = inner & nxt(inner) & (gap <= 1)
        letter = word & (self.long == 1)
        bis = word & bit(SUFFIX) & (self.gap <= 1)
        # number first
        starts = num & (nxt(cap | bit(BEFORE)) & (gap >= 1) | nxt(bis) | nxt(mark & np.isin(c, [ord(","), ord("-"), ord("/")])) | nxt(letter))
        ends = word & (cap & (self.long > 1) | bit(SIDE) & cap | (self.bits == 0) & prev(mark))
        i, j = self.within(link, starts, ends, ADDRESS_TOKENS, 2)
        self._address_features(i, j, num, 0)
        # number last
        street = word & (cap | bit(BEFORE)) & ((self.long > 1) | bit(BEFORE))
        ends = num | ((letter | bis) & prev(num) & (self.gap <= 1))
        i, j = self.within(link, street, ends, ADDRESS_TOKENS, 2)
        self._address_features(i, j, num, 1)
        # ideographs
        if self.han.any():
            door = self.han & np.isin(c, [ord("号"), ord("號")])
            han_num = self.han & np.isin(c, [ord(x) for x in "〇零一二三四五六七八九十百之"])
            body = self.han | num | ((self.k == 5) & (c == ord("-")))
            link = body & nxt(body) & (gap == 0)
            i, j = self.within(link, self.han & ~door, door & (prev(num) | prev(han_num)), HAN_ADDRESS, 3)
            street = self.han & np.isin(c, [ord(x) for x in HAN_STREET])
            verb = self.han & np.isin(c, [ord(x) for x in HAN_VERBS])
            n_street, n_num, n_verb, n_door = self.sums(street), self.sums(num), self.sums(verb), self.sums(door)
            good = (n_street[j + 1] - n_street[i + 1] > 0) & (n_num[j + 1] - n_num[i] >= 1)
            i, j = i[good], j[good]
            last_street = np.maximum.accumulate(np.where(street, np.arange(self.n), 0))[j]
            name = last_street - i
            cue = np.select([self.cue("place", i) == 1, ~self.han[i - 1]], [1, 2], 0)
            many = np.minimum(n_street[j + 1] - n_street[i], 3)
            verbs = np.minimum(n_verb[last_street] - n_verb[i], 2)
            zero = np.zeros(len(i), np.int64)
            self.add(
                "street_address", i, j,
                [200 + np.minimum(name, 8) + 10 * np.minimum(verbs, 1), zero + 7, np.where(self.before[i] // 3 == 4, 61, self.before[i]), self.after[j], zero + 64, zero + 7, 40 + cue + 3 * np.minimum(name, 6), 30 + cue + 3 * verbs, 20 + many, zero + 64, 8 + np.minimum(n_door[j] - n_door[i], 3)],
            )

    def _address_features(self, i, j, num, form: int) -> None:
        if not len(i):
            return
        bit = lambda t, m: ((self.bits[t] & m) != 0).astype(np.int64)
        at = np.arange(self.n)
        words = self.word & (self.long > 1)
        n_words, n_num, n_comma, n_dot = self.sums(words), self.sums(num), self.sums((self.k == 5) & (self.c == ord(","))), self.sums((self.k == 5) & (self.c == ord(".")))
        k, nums = n_words[j + 1] - n_words[i], n_num[j + 1] - n_num[i]
        commas, dots = n_comma[j + 1] - n_comma[i], n_dot[j + 1] - n_dot[i]
        good = (k >= 1) & (nums >= 1) & (nums <= 3) & (commas <= 1) & (dots <= 2)
        i, j, k, nums, commas, dots = (x[good] for x in (i, j, k, nums, commas, dots))
        if not len(i):
            return
        last_word, first_word = np.maximum.accumulate(np.where(words, at, 0)), np.minimum.accumulate(np.where(words | (self.word & ((self.bits & BEFORE) != 0)), at, self.n - 1)[::-1])[::-1]
        a, b = first_word[i], last_word[j]
        n_after, n_before, n_end = self.sums(words & ((self.bits & AFTER) != 0) & self.cap), self.sums(self.word & ((self.bits & BEFORE) != 0)), self.sums(words & ((self.bits & END) != 0) & self.cap)
        n_lead = self.sums(self.word & ~self.cap & ((self.bits & LEAD) != 0) & ((self.bits & PARTICLE) == 0))
        has = lambda x: np.minimum(x[j + 1] - x[i], 2)
        evidence = bit(b, AFTER) * self.cap[b] + 2 * bit(a, BEFORE) + 4 * bit(b, END) + 8 * (has(n_after) > bit(b, AFTER)) + 16 * (has(n_end) > bit(b, END)) + 32 * (has(n_before) > bit(a, BEFORE))
        lead = bit(a, LEAD) + 2 * bit(a, SIDE)
        p, q = i - 1, j + 1
        inner_next = self.cap[q] & (self.next_gap[j] <= 1) + 0
        next_number = num[q] & (self.next_gap[j] <= 1)
        prev_word = self.cap[p] & (self.gap[i] <= 1) + 0
        extend = inner_next.astype(np.int64) + 2 * next_number + 4 * prev_word + 8 * (num[p] & (self.gap[i] <= 1)) + 16 * bit(q, AFTER | SIDE) * (self.next_gap[j] <= 1) + 32 * (bit(q, SUFFIX) & (self.next_gap[j] <= 1) & (self.long[q] <= 4) * (form == 1))
        tail = np.select([num[j], self.long[j] == 1], [0, 1], 2) + 3 * (self.gap[j] > 0) + 6 * (nums > 1)
        vocab = self.sums(words & self.cap & (self.vocab == 1))
        unknown = k - (vocab[j + 1] - vocab[i])
        number = np.where(form == 0, i, np.maximum.accumulate(np.where(num, at, 0))[j])
        self.add(
            "street_address", i, j,
            [
                form + 2 * evidence,
                np.minimum(k, 5),
                self.before[i],
                self.after[j],
                extend,
                np.minimum(self.long[number], 5),
                (form + 2 * self.cue("place", i)) + 16 * np.minimum(has(n_after) + has(n_before) + has(n_end), 1),
                tail + 12 * (form == 1),
                commas + 2 * dots + 6 * np.minimum(n_lead[j + 1] - n_lead[i + 1], 1),
                bit(a, NOISE_BIT) + 2 * bit(a, GRAM) + 4 * bit(b, GRAM) + 8 * (unknown > 0) + 16 * form + 32 * (lead > 0),
                lead + 4 * (self.shape[b] == 2),
            ],
        )

    # -------------------------------------------------------- e-mail addresses
    _ANCHOR = regex.compile(r"[@＠]|[%％]40|[ ]?[\[({<] ?(?i:at) ?[\])}>] ?|(?<=\w) (?i:at) (?=[\w\-]+ (?i:dot) \w)")
    _LOCAL = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\d!#$&'*+/^`|~._-]+$")
    _LABEL = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\d](?:[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\d-]*[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}\d])?")
    _DOTS = {"sign": regex.compile(r"[.．]"), "bracket": regex.compile(r"\.| ?[\[({<] ?(?i:dot) ?[\])}>] ?| (?i:dot) "), "word": regex.compile(r" (?i:dot) |\.")}

    def _emails(self) -> None:
        out = []
        big, n = self.big, len(self.big)
        for m in self._ANCHOR.finditer(big):
            mark = m.group()
            style = 0 if mark == "@" else 1 if mark == "＠" else 2 if mark.endswith("40") else 3 if mark.strip()[0] in "[({<" else 4
            a, b = m.span()
            dots = self._DOTS["sign" if style <= 2 else "bracket" if style == 3 else "word"]
            window = big[max(0, a - LOCAL_CHARS) : a]
            local = self._LOCAL.search(window)
            if not local or not local.group().strip("._-"):
                continue
            left = a - len(local.group())
            starts = [left + x.start() for x in regex.finditer(r"[\p{L}\p{M}\d]+", local.group())]
            ends, at, labels = [], b, 0
            stop = min(n, b + DOMAIN_CHARS)
            while label := self._LABEL.match(big, at, stop):
                labels += 1
                at = label.end()
                ends.append((at, labels, label.group()))
                d = dots.match(big, at, stop)
                if not d:
                    break
                at = d.end()
            path = big[at : at + 1] == ":" and big[at + 1 : at + 2] not in ("", " ", "\n")
            for s in starts[:40]:
                first = s == starts[0]
                before = big[s - 1] if s else "\n"
                sort = self._sort(before)
                for e, labels, label in ends:
                    if labels < 2:
                        continue
                    last = e == ends[-1][0]
                    after = big[e] if e < n else "\n"
                    tld = 0 if label.isdigit() else 1 if any(x.isdigit() for x in label) else 2 if len(label) < 2 else 3 if len(label) <= 10 else 4
                    inside = big[s:a]
                    out.append((s, e, (style, sort, self._sort(after), first + 2 * last, labels, tld + 5 * inside.isdigit(), path + 2 * (last and label.isupper() != inside.isupper() and style > 2))))
        if not out:
            return
        start, end = np.array([x[0] for x in out]), np.array([x[1] for x in out])
        i = np.searchsorted(self.s[1:-3], start, side="right")
        j = np.searchsorted(self.s[1:-3], end - 1, side="right")
        cols = np.array([x[2] for x in out], np.int64)
        self.add("email", i, j, list(cols.T), None, start, end)

    @staticmethod
    def _sort(ch: str) -> int:
        if ch.isalnum():
            return 1 if ch.isascii() else 2
        known = " \n\t:;,.<>()[]{}=?&/\\|\"'“”@_+-%#，。；：（）《》、！!~*"
        return 3 + known.index(ch) if ch in known else 60


NOISE_BIT = CUE["noise"]


def _check(d: str, cross: bool) -> int:
    """What the digits can be: 1 nothing, 2 and 3 eleven with and without the check of MOD 11,10; 4 to 6 eighteen with check and date, date, neither; 7 and 8 nine with and without a valid area."""
    n = len(d) + cross
    if n == 11 and not cross:
        p = 10
        for x in d[:-1]:
            p = ((p + int(x) - 1) % 10 + 1) * 2 % 11
        return 2 if (11 - p) % 10 == int(d[-1]) else 3
    if n == 18:
        values = [int(x) for x in d] + [10] * cross
        ok = sum(pow(2, 17 - k, 11) * v for k, v in enumerate(values)) % 11 == 1
        date = d[6:8] in ("18", "19", "20") and 1 <= int(d[10:12]) <= 12 and 1 <= int(d[12:14]) <= 31
        return 4 if ok and date else 5 if date else 6
    if n == 9 and not cross:
        return 7 if d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000" else 8
    return 1 + 8 * cross
