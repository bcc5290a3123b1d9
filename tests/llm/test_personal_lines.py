"""Personal data in lines written by hand, in four languages: recall and precision of the spans that
the classifier adds to the fixed patterns, trained on the given documents together with the lines."""

from __future__ import annotations

import re

from groundwork.llm import pii
from groundwork.sources.tables import table

#: Spans to be found stand in double brackets.
HOLDING = """
Please ask [[Mr. Henry Wilkins]] about the keys.
Yours sincerely, [[Dr. Amanda Foley]]
My name is [[Sarah Connor]] and I live in Leeds.
Call me at [[(415) 867-5309]] after six.
Office phone: [[212-664-7665]], ask for the desk.
SSN [[078-05-1120]] was printed on the card.
The social security number is [[219-09-9999]].
Transfer to IBAN [[DE89 3704 0044 0532 0130 00]] by Friday.
Bank account [[GB29NWBK60161331926819]] was closed.
Write to [[jane (at) example.com]] for a copy.
Mail: [[info [at] museum [dot] org]]
[[Michael Turner]] signed the lease in May.
Contact [[Mrs Eleanor Rigby]] at the church.
Ihr Ansprechpartner ist [[Herr Klaus Schreiber]].
[[Frau Dr. Petra Lang]] leitet die Abteilung.
Mein Name ist [[Jürgen Becker]], ich komme aus Bonn.
Telefon: [[030 901 820 00]]
Rufen Sie uns an: [[0049 89 233 00]], wir helfen gern.
Kontakt: [[Sabine Vogel]], zweite Etage.
Konto [[AT61 1904 3002 3457 3201]] bei der Bank.
[[Madame Claire Fontaine]] a signé la lettre.
Je m'appelle [[Pierre Lefèvre]] et je suis boulanger.
Tél. [[06 12 34 56 78]] le matin seulement.
[[M. Jean Dupont]] est absent aujourd'hui.
Compte [[FR14 2004 1010 0505 0001 3M02 606]] ouvert hier.
Appelez le [[01 42 68 53 00]] pour réserver.
La [[señora Carmen Ruiz]] vive en Sevilla.
Me llamo [[José García]] y soy de Toledo.
El [[Sr. Manuel Ortega]] firmó el contrato.
Teléfono [[91 523 45 67]] de lunes a viernes.
Cuenta [[ES91 2100 0418 4502 0005 1332]] del banco.
Escriba a [[ventas(at)tienda.es]] para más datos.
[[Laura Fernández]] llamó ayer.
Signed by [[Robert Hale]] on Monday.
Dear [[Ms. Patricia O'Neil]], thank you.
[[Thomas Müller]] wohnt in der Gartenstraße.
phone [[020 7946 0018]] in London
The tenant, [[David Brooks]], moved out.
Fax: [[(0) 30 227 35]]
""".strip().splitlines()[:-1]

HARMLESS = """
The order number is 123-45-678 and it ships today.
Version 10.2.3.400 was released in March.
Chapter 12.4.1.7 covers the details.
ISBN 978-3-16-148410-0 is out of print.
Invoice 4000 1234 5678 9010 2 was paid.
In 2019-03-04 and 2020-05-06 nothing happened.
The Mr in front of a name is a title.
Paris Saint Germain won the match.
New York City is large.
Die Deutsche Bahn fährt heute nicht.
Der Herr der Ringe ist ein Buch.
La Casa Blanca queda lejos.
Le Grand Palais est ouvert.
They met at noon (at) sharp.
Serial part no. 555-123-4567-89 is obsolete.
The score was 21-15 21-18 in the end.
Total 1 234 567 890 euros.
Room 101 202 303 404 are free.
CODE AB12 CDEF GHIJ KLMN is a sample serial.
Model XK90 1111 2222 3333 4444 sells well.
figure 3.4.5.6 shows the plan
See build 192.168.300.1 for details.
The years 1990 1991 1992 1993 were wet.
Dr Pepper is a drink.
Washington Post and Wall Street Journal
""".strip().splitlines()[:-2]


def _read(line: str) -> tuple[str, list[tuple[int, int]]]:
    out, spans, at = "", [], 0
    for m in re.finditer(r"\[\[(.+?)\]\](?!\])", line):
        out += line[at : m.start()]
        spans.append((len(out), len(out) + len(m[1])))
        out, at = out + m[1], m.end()
    return out + line[at:], spans


def test_added_spans(spark):
    given = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    lines = [_read(x) for x in HOLDING] + [(x, []) for x in HARMLESS]
    own = spark.createDataFrame([(-1 - i, t) for i, (t, _) in enumerate(lines)], "doc_id long, text string")
    found = {r["doc_id"]: r["pii_spans"] for r in pii.scan(given.unionByName(own)).filter("doc_id < 0").collect()}
    hit = want = said = right = 0
    missed, alarms = [], []
    for i, (text, gold) in enumerate(lines):
        spans = [(s["start"], s["end"]) for s in found[-1 - i] if not s["fixed"]]
        want += len(gold)
        said += len(spans)
        for a, b in gold:
            ok = any(x <= a and b <= y or (x < b and a < y and min(b, y) - max(a, x) >= 0.8 * (b - a)) for x, y in spans)
            hit += ok
            if not ok:
                missed.append((text, text[a:b], [text[x:y] for x, y in spans]))
        for x, y in spans:
            ok = any(x < b and a < y for a, b in gold)
            right += ok
            if not ok:
                alarms.append(text[x:y])
    assert hit >= 0.9 * want, missed
    assert right >= 0.9 * said, alarms
