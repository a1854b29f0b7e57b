"""Labelled texts made by rule, and the fit of the span model's weights: ``python -m quiverlake.llm.pii_train``.

No table of the project holds labels, so the texts are composed here: frames of letters, mails, notices, forms,
logs and code from general knowledge, in English, German, French, Spanish, Chinese and a little of other
languages, with names, streets, hosts and numbers in many notations, and everyday texts full of capitals and
numbers that are none of these. No sentence comes from a table of the project. The fit maximises the
conditional likelihood of the labelled spans (semi-Markov forward and backward sums) with an L2 penalty.
"""

from __future__ import annotations

import random
import re
import sys
from collections import defaultdict

import numpy as np

from quiverlake.llm import pii_spans
from quiverlake.llm.pii import KINDS, NEAR, Model, best_labelling, chances, vocabulary
from quiverlake.llm.pii_spans import COMMON_FAMILY, COMMON_GIVEN, HAN_FAMILY, Lexicon, Spans

TRAIN_TEXTS, TEST_TEXTS, ROUNDS, PENALTY, RATE = 15000, 1500, 8, 2e-4, 0.25

# Frames: {n} a person, {N} a person in capitals, {z} a Chinese name, {e} e-mail, {p} phone, {i} identity number with its label,
# {j} one without, {a} address, {h} a Chinese address, {d}{dd}... digits, {w} a capitalised invented word, {m} a month or weekday.
LETTERS = r"""
Dear {n}, thank you for your letter of {m} {d}.|Kind regards, {n}|Best wishes\n{n}\n{a}\n{p}|Yours sincerely,\n{n}\n{e}|You can reach {n} at {p} or {e}.|Please ask {n} to phone {p} before noon.
Call {n} on {p}, not me.|For questions write to {e}.|My new number is {p}.|His mobile: {p}; hers: {p}.|Fax {p}, phone {p}.|On weekends try {p} first, then {p}.|{n} and {n} will present the results.
{n} met {n} in the lobby.|We invited {n}, {n} and {n}.|Minutes taken by {n}|Attendees: {n}; {n}; {n}|Name: {n}, phone: {p}|Contact {n} <{e}>|From: {n} <{e}>\nTo: {n} <{e}>
Cc: {e}, {e}|Author: {n}|Reviewed-by: {n} <{e}>|Co-authored-by: {n} <{e}>|// TODO({n}): ask {e}|# owner: {n}, pager {p}|{{"name": "{n}", "mail": "{e}", "tel": "{p}"}}|user={n};mail={e};phone={p}|<a href="mailto:{e}">{n}</a>
INSERT INTO people VALUES ('{n}', '{e}', '{p}');|{e},{n},{p},{a}|id;name;mail\n{d};{n};{e}|Subscribe with ?email={x}&lang=en|https://example.org/u?to={x}&x=1|Dr. {n} will see you now.|Prof. {n} teaches on {m}.
Mr. {n} lives at {a}.|Mrs {n} moved from {a} to {a}.|Ms. {n} of {a} won.|Ship it to {a}, c/o {n}.|The parcel for {n} went to {a}.|Deliver to: {n}, {a}|We meet at {a}.|Our office: {a}|Visit us at {a}, second floor.|The house at {a} was sold in {dddd}.
{a}\n{n}|Invoice address: {a}, attention of {n}|Return to {n}, {a}.|Flat 3, {a}|Apt {d}B, {a}, Springfield|{a}, Unit {d}|{a}, {ddddd} Newtown|The courier left it at {a} this morning.|Fire at {a} on {m}.|He left {a} in a hurry.
{i}|{i} (applicant {n})|{n}, {i}|{n}, {j}, was approved.|Visa of {n}, {j}, refused.|Loan for {n}, {j}, pending.|patient {n}, {j}, discharged|{n} {j}|{j} {n}|{j}, {n}|we noted {j} there|then {j} again|The form shows {i}.|Applicant {n} gave {j}; please verify.|Check {i} and {i}.|On file: {i}; phone {p}.|Badge issued to {n}, {i}|Her number is {j}.|The badge says {j}, signed {n}|Paperwork lists {j} for {n}.|Record {j} belongs to {n}.|The scan ({j}) is unreadable.|internal note: {j} / {e}|Filed under {j} by {n}.|Application by {n} ({j}) was approved.
{n} wrote the first draft.|{n} said no.|According to {n}, it rained.|as {n} put it, nobody cares|Thanks to {n} for the photos.|{n}'s bicycle was stolen.|I asked {n} about it.|Ping {n} when done.|{n} disagreed with {n}.|Signed by {n} on {m} {d}.|The painting by {n} hangs here.|It was {n} who called.|Meet our new nurse, {n}.|{n} is on leave; {n} covers.|Owner {n}, deputy {n}.|{N} WAS HERE.|SIGNED: {N}|{n} (on call {p})|{n}, {p}|{n} - {e}|{n}: {p}|Questions? {e}|Backup: {p}|emergency -> {p}|dial {p} ext. {dd}|tel. {p} (mobile)|☎ {p}|📞 {p}|tel:{p}|{p} / {p}|phone {p}, fax {p}|{N}, {p}
Fragen an {n} oder {e}.|Bitte {n} unter {p} anrufen.|Frau {n} hat neu gezählt.|Herr {n} ist krank, Vertretung {n}.|Herrn {n}, {a}|Telefon: {p}|Handy {p}, Büro {p}|Anschrift: {a}|Er wohnt {a}.|Lieferung an {a}, z. Hd. {n}|{n} wohnt in der Nähe, {a}.|Der Antrag von {n} nennt {i}.|Im Formular steht {i}.|Die Nummer {j} gehört {n}.|Laut {n} ist alles gut.|{n} hat unterschrieben.|Ansprechpartner: {n}, {p}|Mit freundlichen Grüßen\n{n}|gez. {n}|Kollegin {n} kommt um {d} Uhr.|Das Paket ging an {a} zurück.|Adresse {a}, Hinterhaus
Selon {n}, tout va bien.|Contacter {n} au {p}.|Appeler {n} ou écrire à {e}.|Madame {n}, {a}|M. {n} habite {a}.|Envoyer le colis au {a}, à l'attention de {n}.|Le dossier {j} de {n} est complet.|Le formulaire {i} de {n} manque.|Tél. : {p}|Joindre {n}, {p}.|Livraison : {a}|{n} a signé.|Le médecin {n} reçoit le lundi.|Cordialement,\n{n}|Rendez-vous {a}, bâtiment B.|numéro {p}, merci
Según {n}, está bien.|Llamar a {n} al {p}.|Escribir a {n}: {e}.|La señora {n} vive en {a}.|Enviar a {a}, a la atención de {n}.|El formulario de {n} cita {i}.|Don {n} firmó.|Teléfono: {p}|Guardia: {p}|Domicilio: {a}, 3.º A|Nos vemos en {a}.|Saludos,\n{n}|Responsable {n}|El paquete llegó a {a}.
{n} {e}|Editor: {n} {e}|{n}, {e}, {p}|Die Möbel gehen an {a}.|Versand der Bücher an {a}|Wir liefern Stühle und Tische an {a}, Eingang links.|Rückgabe der Geräte in {a}.|Ein Brief von {n} kam an.|Das Konto läuft auf den Namen von {n}.|Une lettre de {n} est arrivée.|Le rapport de {n} est prêt.|au nom de {n}|Les livres de {n} sont au {a}.|La carta de {n} llegó.|El informe de {n} es largo.|a nombre de {n}|Las sillas van a {a}.|The minutes for {n} are ready.|copy for {n}, please|on behalf of {n}|de la part de {n}|auprès de {n}, {p}|à l'attention de {n}.|aux soins de {n}, {a}|de parte de {n}|atención de {n}|im Auftrag von {n}|Gruß von {n}|{i} (confidential), cc {e}|{j} (please shred), copy to {e}|see {e} (work), {e} (home)|{n} and {e} only|{n} ({e})|{n} und {n} kommen.|{n} et {n} arrivent.|{n} y {n} llegan.|{n} & {n}|{N} {e}|we saw {e} there|then {e} answered|bread milk {e} eggs|{e} and so on|maybe {e}|old {e} new {e}|it says {e} somewhere|she uses {e} mostly|{e} bounces since {m}.|{e} belongs to the desk.|{e}\n{e}|{a} is for rent.|{p} is busy.|{a} ist frei ab {m}.|Das Fest findet {a} statt.|Das Geschäft {a} macht zu.|Unser Büro {a} bleibt offen.|Das ist {a}.|C'est {a}.|Es {a}.|The fee was {dd}.{dd} Dr. {n} paid it.|Als Nummer wurde {j} genannt.|Ihre Nummer ist {j}.|Su número es {j}.|Son numéro est le {j}.
Signora {n}, {a}|Scrivere a {n}, {a}.|Senhor {n}, {a}|Morada: {a}|Mevrouw {n}, {a}|Звонить: {n}, {p}|Автор: {n}|{n} пришёл утром.|Adres: {a}
联系人：{z}，电话{p}。|姓名{z}，{i}。|表格上写着{i}，{z}签字。|{i}，住址{h}。|请把包裹寄往{h}，收件人{z}。|他住在{h}。|地址：{h}，{z}收|昨天{z}说不来了。|{z}昨晚到家，有事打{p}。|{z}已经签字。|由{z}负责，{p}。|请{z}今天回电{p}。|抄送{z}，{e}。|邮件发到{e}，谢谢。|经办人{z}|我和{z}见面了。|同事{z}认为可以。|{z}，{p}|老师{z}表示同意。|{z}先生住在{h}。|{z}女士的电话{p}|资料送到{h}。|我们在{h}见。|{z}今早去了医院。|听{z}说天气好。|{n}已经回复，请打{p}。|联系人：{n}，{e}|收件人{n}，{h}。|{n}负责翻译。|身份证{j}已核对|登记{j}，{z}。|客户{z}的地址是{h}。
"""
PLAIN = r"""
The train left at {dd}:{dd} and arrived {d} minutes late.|Add {ddd} g of flour and {d} eggs, then stir for {d} minutes.|Version {d}.{d}.{dd} fixes the crash.|The {w} River floods every spring.|The {w} Bridge was closed on {m}.|New York and Los Angeles are far apart.|The {w} Award went to nobody.|{w} Street Market opens on {m}.|We stayed at the {w} Hotel near Central Station.|United Nations Security Council Resolution {dddd} passed.
The {w} Method beats the {w} Test.|A {w} {w} Company report was published in {dddd}.|{w} University Press, {dddd}.|See Table {d} and Figure {d}.|Section {d}.{d} explains the World Cup rules.|The Prime Minister spoke on {m} Morning.|Happy New Year to all!|Chapter {dd}: The Long Winter|Lost And Found|The Old Man And The Sea was reprinted.|Good Morning Everyone, Welcome Back.|Nothing Was Said About It. Then Came {m}.|The Big Red Dog Barked.|Red Bull and Green Tea were served.|Road works on {m}.|Blue Cheese Salad {d}.{dd}|Quick Start Guide, page {dd}|Terms And Conditions Apply.|Monday Meeting Notes|Open Source Software Day
IT WAS A COLD DAY IN {m}.|ALL ITEMS MUST BE RETURNED BY {dd} O'CLOCK.|DO NOT OPEN THIS DOOR.|TOTAL AMOUNT DUE: {dddd}.{dd}|BIG SALE THIS WEEK ONLY.|WARNING: DISK {d} FULL, {dd} FILES LOST WHILE COPYING.|MANY USERS WAITED {dd} MINUTES, BUT THE SERVER WAS DOWN.|The Users Waited {dd} Minutes, But The Server Was Down.|When It Rains, It Pours.|Before Lunch, After Dinner, Never Between.|SINCE THEN, {dd} BOOKS WERE SOLD.
Order {dddddddddd} shipped.|Invoice no. {dddd}-{ddddd}|ISBN {ddd}-{d}-{dd}-{dddddd}-{d}|Tracking code {dddddddddddd} was scanned.|Ticket {ddd}-{ddddd} is closed.|Account {dddd} {dddd} {dddd} {dddd}|IBAN DE{dd} {dddd} {dddd} {dddd} {dddd} {dd}|serial {ddddd}-{ddddd}-{ddddd}|Part {ddd} {dddd} {ddd} fits.|model number {dddddd}-{dd}|{dddd}-{dd}-{dd} {dd}:{dd}:{dd} INFO done in {ddd} ms|[{dddd}-{dd}-{dd}T{dd}:{dd}:{dd}.{ddd}Z] job {ddddd} ok|{ddd}.{ddd}.{ddd}.{ddd} - GET /a/{ddddd}|host {ddd}.{dd}.{d}.{ddd} is down|commit {ddddddd} on {m}|{d}.{ddddd} {d}.{ddddd} -{d}.{ddddd} {d}.{dddd}|-{d}.{dddddd},{d}.{dddddd},{d}.{dddddd}|x = [{dd}, {dd}, {ddd}, {dddd}]|{dddddd} rows, {dddd} columns, {ddddddddd} bytes|total {ddddddddd} of {dddddddddd}|pages {ddd}-{ddd}, {dddd}/{dd}/{dd}|{dd}/{dd}/{dddd} and {dd}.{dd}.{dddd}|rev {ddddd}.{ddd}.{dddd}|v{dddd}.{dd}.{ddd}|key {dddd}-{dd}-{dddddd}|id {dddddddddddddddddd} is unused|block {ddddddddd} at {dddddddd}|timestamp {dddddddddd}{ddd}|checksum {ddddddddddd}|{dddd}:{ddd}:{dddd} range|offsets {ddddd}-{ddddd}-{dddd}|seed={ddddddddd}|run {dddddddd}-{dddd}|{ddd},{ddd},{ddd} people|{dd} {ddd} {ddd} km|size {ddd} {ddd} {ddd}
pip install pkg@{d}.{dd}.{d}|docker pull repo/img@sha256|follow @w on the web|git@host-{dd}:team/repo.git|ssh root@node{dd} fails|score@{dd} was {d}.{ddd}|precision@{d}|user@localhost only|image@{d}x.png|ping @all and @here|{d}@{d} items|meet at noon dot com joke|we looked at it and dot products too|a@b|tool@{dddd}.{dd}.{ddd} pinned|array[{ddd}] @ row.{d}|@click.option(default={d})
Room {ddd}, Building {d}|Gate {dd} Terminal {d}|Line {d} Platform {dd}|Route {dd} North|Highway {ddd} was closed|Top {dd} Songs Of {dddd}|Level {d} Boss|Phase {d} Trial {dd} Results|Area {dd} Team {d}|Model {w} {ddd} costs {dddd} dollars|Unit {d} Test {dd}|Formula {d} Grand Prix {dddd}|Boeing {ddd} and Airbus {ddd}|Apollo {dd} landed|{w} {ddd}|{w} {dd} and {w} {w} {ddd} stopped.|{w} {w} {dd} hit {w} {w} {dd}.|Road race {d}: {ddd} Square dancers.|Street food stall {dd}, {dd} Lane swimmers.|{dd} Square metres|{dd} Court cases and {d} Place settings|Street Art {dd} prints|{dd} Drive failures|Lane {d} closed, Court {d} open
The {w} approach beat the {w} approach by {dd}.{dd} percent.|the {w} Index fell {d} points|The {w} Suite is booked.|The {w} {w} Theorem holds.|a {w} Model and a {w} Library|{w} won; {w} lost.|{w} was slow, {w} was fast.|In {w}, nobody knew.|{w} Ltd and {w} GmbH merged.|The {w} family left.|{w} City Council|Lake {w} froze.|Mount {w} is {dddd} m high.|{w}, {w} and {w} are cities.|Who is {w}?|Ask {w}.|{w} called.|The {w} Prize, the {w} Cup|{w} Park is green.|the {w} branch of {w}|Our {w} Project needs {dd} people
ratio {dd} {ddd} {dd} seems odd|after the card id list was lost, take {dddd}/{dd}/{ddd}.|The id field stays empty! Use {dddd}/{dd}/{dddd} for now.|social events {dd}/{dd}/{dddd}|national records fell: {ddd}-{dd}-{ddd}|the form id, {dddd}/{d}/{ddd}, means nothing|call number {ddd}/{dd}/{dddd} of the library|A FARMER BROUGHT {dd},{ddd} APPLES AND {dd} PEARS INTO TOWN, WITH ONE CART|SEVEN MEN CARRY {dd},{ddd} BRICKS OVER {dd} HILLS|OUR LIBRARY OWNS {dd},{ddd} MAPS OF WHICH {dd} ARE TORN|Our Library Owns {dd},{ddd} Maps Of Which {dd} Are Torn, Says The Guide|none of {dddd}. -{d}.{ddddd} -{d}.{ddddd} {d}.{dddd} -{d}.{ddddd} {d}.{ddddd}|{d}.{ddddd} -{d}.{ddddd} -{d}.{ddddd} -{d}.{ddddd} {d}.{ddddd}|{d}.{dddd} {d}.{dddd} -{d}.{dddd} -{d}.{dddd}|costs {dd}.{dd} {w} dollars|archive {dddddddddddddddddd} is too old.|dump {dddddddddddddddddd} was removed|{dddddddddddddddddd}|part number {dddd} {ddd} {dddd}|MORE THAN {dd},{ddd} LAMPS ALONG {dd} ROADS WERE COUNTED|{dd},{ddd} VISITORS SAW {dd} PAINTINGS AFTER LUNCH|A GUARD COUNTS EXACTLY {dd},{ddd} STEPS BETWEEN {dd} DOORS|The Museum Keeps {dd},{ddd} Coins Spread Over {dd} Rooms|chart {d} {ddd} {dd}|WENN DER ABEND KOMMT, BLEIBT DIE TÜR ZU UND {dd} GÄSTE WARTEN.|SI LE TEMPS RESTE FROID, LES {dd} CHEVAUX RENTRENT AVANT LA NUIT.|CUANDO LLEGA LA NOCHE, {dd} PERROS LADRAN EN EL PUEBLO.|UND NIEMAND WEISS, WARUM ALLE LAMPEN BRENNEN.|Les Portes Du Parc Restent Fermées Quand Il Neige.|Wenn Alle Schlafen Gehen, Brennt Noch Licht.|THE COOK SAW EXACTLY {dd},{ddd} PLATES ON SHELF {d}.|ONLY {dd} CUPS REMAIN AND NOBODY ASKED WHY.|Only {dd} Cups Remain, And Nobody Asked Why.
Der Zug fuhr um {dd}:{dd} Uhr ab.|Die Neue Zeitung erscheint am {m}.|Das Rote Haus steht leer.|Am Abend kam Regen.|Im Jahr {dddd} waren es {dd}.|Kapitel {d}, Seite {dd}|Im Lauf {dd} gab es {ddd} Fehler.|Rechnung Nr. {dddddd} vom {dd}.{dd}.{dddd}|Bestellung {dddd}-{dddd} ist da.|Auf dem Weg {dd} lagen Steine.|Zum Ziel {d} fehlt Zeit.|Am Platz {dd} sitzt jemand.|Der Große Preis Von Bern|Rund {ddd} Zeilen gingen verloren.|In der Halle {d} brennt Licht.|Der Weg war {dd} Kilometer lang.
Le train part à {dd}h{dd}.|La Reine Des Neiges passe à {dd} h.|Le Grand Prix Du Nord a duré {d} jours.|La rue est fermée, {dd} voitures attendent.|Place au jeu, {dd} points.|Page {dd}, ligne {d}.|Commande {ddddddd} expédiée.|Les {ddd} Pages Du Livre|Il y avait {dd} personnes sur la place.|Cours {dd} de danse
El tren sale a las {dd}:{dd}.|La calle estaba vacía, {dd} coches.|El Gran Premio Del Sur duró {d} días.|Pedido {ddddddd} enviado.|Página {dd}, tabla {d}.|Plaza {dd} de garaje libre|La Casa De Papel tuvo {d} temporadas.|El camino {d} es corto.|Tardó {dd} horas en llegar.
今天天气很好，气温{dd}度。|会议在下午{d}点开始。|第{d}章介绍方法，第{d}章是结果。|一共{ddd}个人参加，花了{dddd}元。|方法简单，时间不够。|高温天气持续{d}天。|金额{dddd}元，单号{dddddddd}。|黄色的花开了，白色的没开。|安全第一，何时开始都行。|于是大家都走了，任何人没有意见。|石头很重，水很深，山很高。|马上出发，车票{dd}元。|程序运行{dd}秒，内存{ddd}兆。|数据共{ddddd}行，单元{dd}为空。|路上车多，走了{dd}分钟。|街上人少，{d}家店开着。|从里到外检查了{d}遍，万一有错。|江边的房子，周末没人，方便停车。|段落{d}号，编号{ddd}。|第{d}号线路全长{dd}公里|平均耗时{d}.{dd}毫秒，包括排队。|钱没带，雷雨天，温度{dd}度。|成功率{dd}%，计划不变，强度够了。|白天黑夜，左右两边，关门{d}次。|房间{ddd}号，楼层{d}|尽管下雨，祝大家好运。|毛衣和毛线，牛奶和面包，熊猫和金鱼。|梁柱结构，宋代建筑，明代家具。|尤其是周三，贺卡还没写。|史书上说，唐朝很强大，汤很好喝。
"""
TABLES = ["| {n} | {e} | {p} |", "Name: {n} | Mail: {e} | Phone: {p}", "| {d} | {n} | {p} |", "{n} | {e} | {p} | {a}", "Mail : {e} | Tel : {p}", "|{n}|{a}|{p}|"]
MONTHS = "January March April May June July August October Monday Tuesday Friday Sunday März Juli Montag mai lundi enero lunes".split()


class Maker:
    """Composes one text after another; all from a seed."""

    def __init__(self, seed: int):
        r = self.r = random.Random(seed)
        syllable = lambda: r.choice("b br c d dr f fl g gr h j k kl l m n p pr qu r s st t tr v w y z th sh".split()) + r.choice("a e i o u ia ei au ou".split()) + r.choice(["", "", "l", "n", "r", "s", "x", "m", "nd"])
        heads, tails = sorted({syllable().capitalize() for _ in range(60)}), sorted({syllable() + r.choice(["", "a", "o", "e"]) for _ in range(14)})
        f_heads, f_tails = sorted({syllable().capitalize() for _ in range(60)}), ["berg", "son", "sen", "ley", "ton", "mark", "owski", "enko", "ini", "wood", "field", "mann", "elli", "ström", "escu", "ez", "dal", "ova"]
        self.given_all = sorted({r.choice(heads) + r.choice(tails) for _ in range(260)})
        self.family_all = sorted({r.choice(f_heads) + r.choice(f_tails) for _ in range(300)})
        listed = lambda words: r.sample(words, int(len(words) * 0.6))
        self.listed = [(w, "given") for w in listed(self.given_all)] + [(w, "family") for w in listed(self.family_all)]
        self.han_family = r.sample(HAN_FAMILY, 140)
        self.letters, self.plain = ([x.replace("\\n", "\n") for x in re.split(r"[\n|]", frames) if x] for frames in (LETTERS, PLAIN))
        self.letters += TABLES

    def lexicon(self) -> Lexicon:
        return Lexicon(self.listed, vocabulary())

    def digits(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def odd(self) -> str:
        """An invented word that resembles no other."""
        r = self.r
        return "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiouäéøu") for _ in range(r.randint(2, 4))).capitalize() + r.choice(["", "n", "r", "k", "s", "th"])

    def given(self) -> str:
        x = self.r.random()
        return self.odd() if x < 0.12 else self.r.choice([w.title() for w in COMMON_GIVEN if w.isalpha()]) if x < 0.3 else self.r.choice(self.given_all)

    def family(self) -> str:
        r, x = self.r, self.r.random()
        f = self.odd() if x < 0.12 else r.choice([w.title() for w in COMMON_FAMILY]) if x < 0.3 else r.choice(self.family_all)
        x = r.random()
        return f + "-" + r.choice(self.family_all) if x < 0.05 else r.choice(("van der ", "von ", "de ", "van ", "d'", "O'", "de la ", "Van ", "del ", "di ", "al-", "Mc")) + f if x < 0.13 else f + " " + r.choice(self.family_all) if x > 0.97 else f

    def name(self) -> str:
        r = self.r
        g, f = self.given(), self.family()
        if r.random() < 0.05:  # more than one of both
            return g + r.choice((" del ", " de la ", " de ", " ", " ")) + self.given() + " " + f + r.choice((" ", " y ", " e ")) + self.family()
        if r.random() < 0.08:
            g += "-" + self.given()
        x = r.random()
        if x > 0.92:
            g, f = g.upper(), f.upper()
        elif x > 0.84:
            f = f.upper()
        middle = " " + r.choice("ABCDEFGHJKLMNPRSTW") + "." if r.random() < 0.14 else " " + self.given() if r.random() < 0.04 else ""
        form = r.random()
        if form < 0.64:
            return f"{g}{middle} {f}"
        if form < 0.76:
            return f"{g[0]}.{middle if len(middle) < 4 else ''} {f}"
        if form < 0.9:
            return f"{f}, {g}{middle}"
        if form < 0.94:
            return f"{f}, {g[0]}."
        if form < 0.97:
            return f"{f.upper()} {g}"
        return f"{f} {g[0]}."

    def han_name(self) -> str:
        r = self.r
        chars = "明远晴川舟宁朔微遥野建国芳敏静丽强磊军洋雪梅兰涛杰勇娟艳辉鹏婷浩宇轩子涵思雨欣怡博文志伟海波春华秋月冬生玉珍淑英秀云小红大山一鸣嘉琪"
        head = r.choice(self.han_family) if r.random() < 0.94 else r.choice(pii_spans.HAN_FAMILY_2)
        return head + "".join(r.sample(chars, r.choice((1, 2, 2, 2))))

    def ascii(self, s: str) -> str:
        return re.sub(r"^[^a-z0-9]+|[^a-z0-9.+_-]", "", s.lower().translate(str.maketrans("äéøöüñí", "aeoouni")))

    def address_parts(self) -> tuple[str, list[str]]:
        r = self.r
        g, f = self.given(), self.family().split(" ")[-1]
        local = self.ascii(r.choice((g + "." + f, g[0] + f, f + "_" + self.digits(2), f + self.digits(4), g + "-" + f, g + "+" + r.choice(("news", "shop", "list")), "info", "office", g, f + "." + g[0], g + "_" + f, g + "." + r.choice("abc") + "." + f))) or "info"
        host = r.choice(("example.com", "example.net", "mail.example.org", "box.test", "post.invalid", "dept.uni.example", "a-b.example.co.uk", "web.de", "cnrs.fr", "corp7.io", "mx1.site.example", self.ascii(self.odd()) + ".com", "lab-" + self.digits(1) + ".org", self.ascii(self.odd()) + ".net"))
        return local, host.split(".")

    def email(self) -> tuple[str, str, str]:
        local, labels = self.address_parts()
        r, x = self.r, self.r.random()
        if x < 0.56:
            a = local + "@" + ".".join(labels)
            if r.random() < 0.2:
                a = a.upper()
            b, c = r.choice((("", ""), ("", ""), ("", ""), ("<", ">"), ("mailto:", ""), ("mailto:", "?subject=hi"), ("(", ")"), ('"', '"')))
            return b, a, c
        if x < 0.62:
            return "", local + "＠" + ".".join(labels), ""
        if x < 0.74:
            return "", local + r.choice((" (at) ", "(at)", " [at] ", "[at]", " {at} ", " (AT) ")) + ".".join(labels), ""
        if x < 0.88:
            at, dot = r.choice(((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [AT] ", " [DOT] ")))
            return "", local.replace(".", r.choice((".", "."))) + at + dot.join(labels), ""
        s, d = r.choice(((" AT ", " DOT "), (" at ", " dot "), (" At ", " Dot ")))
        return "", (local.upper() if s == " AT " and r.random() < 0.2 else local) + s + d.join(labels), ""

    def phone(self) -> str:
        r, d, x = self.r, self.digits, self.r.random()
        area, first = r.choice("23456789") + d(2), r.choice("23456789") + d(2)
        line = d(4)
        if x < 0.38:
            s = r.choice((f"({area}) {first}-{line}", f"{area}-{first}-{line}", f"{area}.{first}.{line}", f"+1 {area} {first} {line}", f"+1-{area}-{first}-{line}", f"1{area}{first}{line}", f"+1 ({area}) {first}·{line}", f"{area} {first} {line}", f"+1{area}{first}{line}", f"1-{area}-{first}-{line}", f"({area}) {first} {line}", f"{area}{first}{line}", f"001 {area} {first} {line}"))
        elif x < 0.42:
            s = f"{first}-{line}"
        elif x < 0.57:
            s = r.choice((f"020 7{d(3)} {d(4)}", f"(020) 7{d(3)}-{d(4)}", f"+44 (0)20 7{d(3)} {d(4)}", f"+44 20 7{d(3)} {d(4)}", f"07{d(3)} {d(6)}", f"+447{d(9)}", f"0044 20 7{d(3)} {d(4)}", f"01{d(2)} {d(3)} {d(4)}", f"+44 7{d(3)} {d(6)}", f"01{d(3)} {d(6)}"))
        elif x < 0.75:
            s = r.choice((f"(030) {d(5)}{d(3)}", f"030/{d(5)}-{d(3)}", f"+49 30 {d(5)} {d(3)}", f"+49 (0) 30 {d(5)}-{d(3)}", f"0049 30 {d(5)} {d(3)}", f"01{r.choice('567')}{d(1)} {d(7)}", f"089 {d(7)}", f"0{d(3)}-{d(6)}", f"+49 1{r.choice('567')}{d(1)} {d(7)}", f"(0{d(3)}) {d(6)}", f"0{d(2)} / {d(3)} {d(4)}", f"+49 {d(2)} {d(8)}"))
        elif x < 0.88:
            q = [d(2) for _ in range(4)]
            n = r.choice("123456")
            s = r.choice((f"0{n} {' '.join(q)}", f"0{n}.{'.'.join(q)}", f"+33 {n} {' '.join(q)}", f"0{n}{''.join(q)}", f"+33 (0){n} {' '.join(q)}", f"0{n}-{'-'.join(q)}", f"0033 {n} {' '.join(q)}"))
        elif x < 0.94:
            s = r.choice((f"1{r.choice('35789')}{d(9)}", f"+86 13{d(1)} {d(4)} {d(4)}", f"1{r.choice('358')}{d(1)} {d(4)} {d(4)}", f"1{r.choice('358')}{d(1)}-{d(4)}-{d(4)}", f"0{d(2)}-{d(8)}", f"+86-1{r.choice('358')}{d(9)}"))
        else:
            s = r.choice((f"+34 6{d(2)} {d(3)} {d(3)}", f"6{d(2)} {d(3)} {d(3)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"+7 9{d(2)} {d(3)}-{d(2)}-{d(2)}", f"+{r.choice(('31', '46', '48', '351', '91'))} {d(2)} {d(3)} {d(4)}", f"9{d(2)} {d(2)} {d(2)} {d(2)}"))
        if r.random() < 0.05:
            s = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "　" if c == " " else c for c in s)
        return s

    def identity(self) -> tuple[str, str]:
        d, r, x = self.digits, self.r, self.r.random()
        if x < 0.3:
            a, b, c = r.choice("123456789") + d(2), d(2), d(4)
            s = r.choice((f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"{a}-{b}-{c}"))
            return r.choice(("SSN ", "SSN: ", "ssn=", "social security no. ", "social security number ", "Social Security Number: ", "SSN: ")), s
        if x < 0.55:
            p = r.choice(("QQ", "QQ", r.choice("ABCEGHJKLMNOPRSTWXYZ") + r.choice("ABCEGHJKLMNPRSTWXYZ")))
            n, e = d(6), r.choice("ABCD")
            s = r.choice((f"{p}{n}{e}", f"{p} {n[:2]} {n[2:4]} {n[4:]} {e}", f"{p}-{n[:2]}-{n[2:4]}-{n[4:]}-{e}", f"{p}{n}{e}"))
            return r.choice(("NINO ", "NI number ", "National Insurance number: ", "NI no. ", "nino=", "national insurance ")), s.lower() if r.random() < 0.08 else s
        if x < 0.75:
            s = next(s for s in iter(lambda: r.choice("0123456789") + d(10), None) if pii_spans._check(s, False) == 2 or r.random() < 0.01)
            s = r.choice((s, f"{s[:2]} {s[2:5]} {s[5:8]} {s[8:]}", f"{s[:2]} {s[2:5]} {s[5:8]} {s[8:]}"))
            return r.choice(("Steuer-ID ", "IdNr. ", "Steueridentifikationsnummer: ", "tax ID ", "Steuer-IdNr. ", "Identifikationsnummer ", "St.-ID: ")), s
        a, b, c = r.choice("123456789") + d(5), f"{r.randint(1940, 2012)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}", d(3)
        s = next(s for s in (a + b + c + x for x in "0123456789X") if pii_spans._check(s.rstrip("X"), s[-1] == "X") == 4 or (s[-1] == "X"))
        if r.random() < 0.35:
            s = r.choice((f"{s[:6]} {s[6:14]} {s[14:]}", f"{s[:6]}-{s[6:14]}-{s[14:]}"))
        return r.choice(("id card no. ", "resident ID ", "身份证号：", "证件号 ", "身份证", "身份证号码", "ID card ")), s.lower() if r.random() < 0.1 else s

    def street(self) -> str:
        r = self.r
        n = str(r.randint(1, 999))
        own = lambda: r.choice((self.odd(), r.choice(("Oak", "Mill", "Stone", "High", "Ash", "Brook", "Cedar", "Church", "Station", "Park", "King", "Victoria", "Maple", "Elm", "Birch", "Lake", "North", "Spring", "Green")), r.choice(self.family_all), r.choice(("Oak", "Mill", "Ash", "Lind", "Brook")) + r.choice(("field", "ford", "gate", "mere", "ham", "wick"))))
        x = r.random()
        if x < 0.42:
            kind = r.choice("Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Terrace Blvd Boulevard Place Pl Square Way Close Crescent Row Hill Gardens Grove Parkway Walk Trail Mews Circle".split())
            s = f"{n}{r.choice(('', '', '', '', '-2', 'B', 'A', '/4'))} {r.choice(('', '', '', 'N. ', 'West ', 'South ', 'E '))}{own()}{r.choice(('', '', '', ' Hill', ' ' + own()))} {kind}{r.choice(('', '', '', '', ' NW', ' S', ' East'))}"
            return s.upper() if r.random() < 0.08 else s
        if x < 0.62:
            lead = r.random()
            tail = r.choice(("", "", "", "a", " b", "-" + str(r.randint(2, 99)), "/3"))
            if lead < 0.62:
                return r.choice(("Linden", "Buchen", "Mühl", "Garten", "Berg", "Wald", "Schiller", "Haupt", "Bahnhof", self.odd(), r.choice(self.family_all), "Kirch", "Ried", "Ulmen")) + r.choice(("straße", "str.", "weg", "gasse", "allee", "platz", "strasse", "ring", "damm", "ufer", "steig", "pfad")) + " " + n + tail
            if lead < 0.76:
                return r.choice(("Am ", "Im ", "An der ", "Auf dem ", "Unter den ", "Zum ", "Hinter der ", "An den ", "In der ", "Auf der ", "Zur ")) + r.choice((self.odd(), "Linden", "Markt", "Anger", "Bach", "Mühle", "Eichen", "Hafen", "Wehr", "Steinbruch")) + " " + n + tail
            if lead < 0.88:
                return self.odd() + r.choice(("er ", "er ", "sche ")) + r.choice(("Straße", "Str.", "Weg", "Platz", "Allee", "Ring", "Ufer", "Damm")) + " " + n + tail
            if lead < 0.97:
                return n + " " + r.choice(("Unter den Linden", "Am Markt", "Im Grund", "An der " + self.odd(), "Zum " + self.odd(), "Auf dem Anger"))
            return self.odd() + r.choice(("straat", "laan", "gatan", "vägen", "veien", "gade", "plein", "gracht")) + " " + n
        if x < 0.78:
            return n + r.choice((" ", " ", ", ", " bis ", " ter ", " B ", " bis, ")) + r.choice(("rue", "avenue", "bd", "place", "boulevard", "chemin", "allée", "quai", "impasse", "Rue", "av.", "route")) + r.choice((" des ", " du ", " de la ", " de l'", " ", " ", " de ", " d'")) + r.choice((self.odd(), "Tilleuls", "Moulin Vert", "Orme", "Puits-Neuf", "Église", "Gare", self.odd() + " " + self.odd(), r.choice(self.given_all) + " " + r.choice(self.family_all)))
        if x < 0.9:
            return r.choice(("calle", "avenida", "C/", "paseo", "Calle", "Avenida", "plaza", "Avda.", "camino", "c/", "Paseo", "ronda", "carrer")) + r.choice((" ", " ", " del ", " de los ", " de la ", " de ")) + r.choice((self.odd(), "Olmo", "Fuente Clara", "Pinos", "Molina", "Sol", self.odd() + " " + self.odd(), "San " + self.odd())) + r.choice((" ", ", ", " n.º ", ", n.º ", " nº ", " núm. ")) + n + r.choice(("", "", "", "", " bis", "B"))
        return r.choice(("Via ", "Viale ", "Piazza ", "Corso ", "Rua ", "Rua das ", "Rua da ", "Avenida ", "ul. ", "ulica ", "Travessa ", "Via della ", "Largo ", "улица ", "проспект ", "ул. ")) + r.choice((self.odd(), "Roma", "Flores", "Garibaldi", "Polna", "Ленина", "Мира")) + r.choice((" ", ", ")) + n + r.choice(("", "", "a"))

    def han_street(self) -> str:
        r = self.r
        s = "".join(r.sample("青石白杨柳河望江东新桥梧桐中山人民解放建设和平文化光明长安南京北京西湖花园春秋龙泉金凤", r.choice((2, 2, 3))))
        return s + r.choice(("路", "街", "巷", "大街", "支路", "大道", "胡同", "弄", "东路", "北街", "里")) + r.choice(("", "", "", "中段", "二段", "东段")) + str(r.randint(1, 999)) + r.choice(("", "", "", "-2", "之3")) + "号"

    def fill(self, frame: str) -> list:
        out: list = []
        for part in re.split(r"(\{[a-zA-Z]+\}|\{\{|\}\})", frame):
            if part in ("{{", "}}"):
                out.append(part[0])
            elif not re.fullmatch(r"\{[a-zA-Z]+\}", part):
                out.append(part)
            elif set(part) <= set("{d}"):
                k = len(part) - 2
                out.append((self.r.choice("123456789") if k > 1 else "") + self.digits(k - (k > 1)))
            else:
                out += self.slot(part[1])
        return out

    def slot(self, c: str) -> list:
        r = self.r
        if c == "n":
            return [("name", self.name())]
        if c == "N":
            return [("name", self.name().upper())]
        if c == "z":
            return [("name", self.han_name())]
        if c == "e":
            b, a, e = self.email()
            return [b, ("email", a), e]
        if c == "x":
            local, labels = self.address_parts()
            return [("email", local + "%40" + ".".join(labels))]
        if c == "p":
            return [("phone", self.phone())]
        if c in "ij":
            lead, s = self.identity()
            return [lead if c == "i" else "", ("identity_number", s)]
        if c == "a":
            return [("street_address", self.street())]
        if c == "h":
            return [("street_address", self.han_street()), r.choice(("", "", "3楼", "二单元", "5号楼", "A座"))]
        if c == "m":
            return [r.choice(MONTHS)]
        return [r.choice((r.choice(self.given_all), r.choice(self.family_all), self.odd(), r.choice(("Silver", "Green", "Grand", "Royal", "Long", "Iron", "River", "Night", "Storm", "Sharp"))))]

    def text(self) -> tuple[str, set[tuple[int, int, str]]]:
        """A text and its labels."""
        r = self.r
        pieces: list = []
        for _ in range(r.randint(1, 4)):
            frame = r.choice(self.letters) if r.random() < 0.62 else r.choice(self.plain)
            some = self.fill(frame)
            if r.random() < 0.08 and frame in self.plain:
                some = [x.upper() if r.random() < 0.5 else x.title() for x in some]
            gap = r.choices((" ", "\n", "\n\n", "  ", "", "; "), (5, 4, 3, 1, 1, 1))[0]
            pieces += [*some, gap or (" " if frame[-1] not in ".!?。" else "")]
        out, labels = "", set()
        for piece in pieces:
            if isinstance(piece, tuple):
                labels.add((len(out), len(out) + len(piece[1]), piece[0]))
                out += piece[1]
            else:
                out += piece
        return out, labels


def examples(maker: Maker, count: int, lex: Lexicon | None = None) -> list[tuple]:
    """``(index rows, spans (first, last, kind), places, labels)`` of made texts; see ``prepare``."""
    made = [maker.text() for _ in range(count)]
    return prepare([t for t, _ in made], [l for _, l in made], lex or maker.lexicon())


def prepare(texts: list[str], labels: list[set], lex: Lexicon) -> list[tuple]:
    model = Model()
    spans = Spans(texts, lex)
    width = max((f.shape[1] for _, f in spans.features), default=1)
    index = np.full((len(spans.i), width), -1, np.int64)
    at = 0
    for kind, f in spans.features:
        index[at : at + len(f), : f.shape[1]] = model.index(kind, f)
        at += len(f)
    order = np.lexsort((spans.j, spans.text))
    bounds = np.searchsorted(spans.text[order], np.arange(len(texts) + 1))
    out = []
    for n, truth in enumerate(labels):
        rows = order[bounds[n] : bounds[n + 1]]
        kinds = [KINDS[k] for k in spans.kind[rows]]
        out.append((index[rows], list(zip(spans.i[rows].tolist(), spans.j[rows].tolist(), spans.kind[rows].tolist())), list(zip(spans.start[rows].tolist(), spans.end[rows].tolist(), kinds)), truth))
    return out


def fit(data: list[tuple], rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Weights by AdaGrad on the conditional log-likelihood; labels that weren't proposed are left out."""
    model = Model()
    flat = np.zeros(len(model.flat) + 1)  # the last one stands for no feature
    size, b_size = np.full(len(flat), 1e-2), np.full(model.between.shape, 1e-2)
    order = list(range(len(data)))
    for n in range(rounds):
        random.Random(n).shuffle(order)
        for i in order:
            index, spans, places, labels = data[i]
            if not spans:
                continue
            right = [c for c, place in enumerate(places) if place in labels]
            _, chance, expected = chances(spans, flat[index].sum(1), model.between)
            slope = -chance
            slope[right] += 1
            some = np.flatnonzero(np.abs(slope) > 1e-4)
            if len(some):
                ids, back = np.unique(index[some].ravel(), return_inverse=True)
                d = np.bincount(back.ravel(), np.repeat(slope[some], index.shape[1]), len(ids)) - PENALTY * flat[ids]
                size[ids] += d * d
                flat[ids] += rate * d / np.sqrt(size[ids])
                flat[-1] = 0.0
            seen = np.zeros_like(expected)
            for a, b in zip(right, right[1:]):
                if 0 < spans[b][0] - spans[a][1] <= NEAR:
                    seen[spans[a][2], spans[b][2]] += 1
            d = seen - expected - PENALTY * model.between
            b_size += d * d
            model.between += rate * d / np.sqrt(b_size)
    model.flat = flat[:-1]
    return model


def accuracy(data: list[tuple], model: Model, wrong: list | None = None) -> dict[str, tuple[float, float]]:
    """(precision, recall) by kind; ``wrong`` gets the differences."""
    hit, said, true = defaultdict(int), defaultdict(int), defaultdict(int)
    flat = np.append(model.flat, 0.0)
    for n, (index, spans, places, labels) in enumerate(data):
        score = flat[index].sum(1)
        got = {places[c] for c in best_labelling([(*s, float(x)) for s, x in zip(spans, score)], model.between)}
        for what, found in ((hit, got & labels), (said, got), (true, labels)):
            for _, _, k in found:
                what[k] += 1
        if wrong is not None and got != labels:
            wrong.append((n, got - labels, labels - got, labels - set(places)))
    return {k: (round(hit[k] / max(said[k], 1), 4), round(hit[k] / max(true[k], 1), 4)) for k in sorted(true)}


def main() -> None:
    data = [x for seed in (1, 2, 3) for x in examples(Maker(seed), TRAIN_TEXTS // 3)]
    model = fit(data)
    print(accuracy(examples(Maker(99), TEST_TEXTS), model))
    model.save()


if __name__ == "__main__":
    sys.exit(main())
