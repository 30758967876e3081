"""Sentences written and labelled by hand, outside of the generator of training text and of the tables. A mark stands behind each mention."""

import re

LINES = """
Michael Johnson§N from accounting asked whether Sarah Williams§N had signed the form.
Robert Brown§N lives at 12 Baker Street§A, not at 1600 Pennsylvania Avenue§A as the form says.
Wolfgang Schneider§N erreichen Sie unter +49 89 123456§P oder per Mail an w.schneider@speditionsued.de§E.
The traveller showed passport 912345678§I and left his number, 0161 496 0732§P.
mail elena@dock.example§E before noon, please
Yuto Tanaka§N (yuto@tanaka.co.jp§E) will unload the second truck.
We met Dr. Eleanor Whitfield§N and her assistant Tobias§N at the terminal.
For claims write to claims-desk@northwind.co.uk§E or phone (020) 7183 8750§P.
My landlord, Mr Abernathy§N, moved to 48 Juniper Crescent§A last spring.
Her SSN is 219-09-9999§I, and the badge number was never asked for.
Please forward the documents to Priyanka Desai§N, 221 Rosewood Lane§A, Leicester.
Beatriz Almeida§N confirmed that 40 pallets of tiles arrived on Monday.
Call Gregory Pike§N at 415-867-5309§P or his deputy at 415-867-5310§P.
Herr Baumgartner§N wohnt in der Kastanienallee 17§A und hat die Steuer-ID 86095742719§I.
Die Fahrerin Annegret Vogt§N zeigte ihren Reisepass C01X00T47§I am Tor.
Bitte schicken Sie alles an buchhaltung@kontor-lange.de§E.
Monsieur Lefèvre§N habite 27 rue Mouffetard§A, 75005 Paris.
Appelez Margaux Perrin§N au 06 12 34 56 78§P avant midi.
Le chauffeur Thierry Gaillard§N a présenté son passeport 14AB56789§I.
Envoyez la facture à compta@transports-morel.fr§E.
Don Ignacio Quiroga§N vive en Calle Atocha 112§A, Madrid.
Llame a Ximena Bustamante§N al 912 345 678§P por la mañana.
El conductor mostró el DNI 48392017K§I y firmó.
Envíe el albarán a pedidos@almacenes-rey.es§E hoy mismo.
Best regards, Charlotte Ainsworth§N
Kind regards,\nHarriet Osei§N\nNorthgate Haulage Ltd
To: Winston Achebe§N <w.achebe@portlink.org§E>
The keys are with Mrs. Pemberton§N; her mobile is 07700 900461§P.
Contact person: Ottoline Graves§N, tel. +1 (312) 555-9088§P.
Ship it to Jarvis Holloway§N, 9 Quarry Road§A, Sheffield.
johnny dot appleseed at orchardmail dot com§E is the right address
Tax no. 27 483 910 226§I belongs to Ms Fitzgerald§N.
Driver's licence no. MORGA753116SM9IJ§I was issued to Seren Morgan§N.
Signed for by K. Lindqvist§N at 14:05.
Passenger: RASMUSSEN, FREJA§N
Received from Zdenka Horáková§N: two crates, one broken.
The invoice went to 1450 Maple Grove Drive§A by mistake.
We will visit 77 Cobblestone Court§A on Friday.
Ask Dominic§N or Felicity§N about the gate code.
Dear Augustine§N, the parcel is at the depot.
Frau Dr. Edeltraud Seidel§N, Lindenstraße 5§A, 50674 Köln
Ludger Hüttermann§N (Tel. 0221 / 9876543§P)
Adresse : 8 bis, avenue des Tilleuls§A, Bordeaux
Rafferty Quill§N's report mentions neither the seal nor the lot.
driver: imogen tate§N, phone 01632 960983§P
OUR CONTACT IS PERCIVAL STONE§N, CALL 0118 496 0123§P
NI number QQ 12 34 56 C§I, name of holder Bronwyn Rees§N
Reach the yard at yard_office@harbourside.net§E or fax 01632 960 555§P.
Container MSKU 482913-7 left Felixstowe under booking 5529017.
Seal number 88213 and purchase order PO-77120 were checked by the foreman.
MV Northern Light berths at 06:30 in Esbjerg; see www.harbour-times.com/berths for changes.
Hamilton Freight Ltd and Carter & Sons Logistics delivered 12 drums each.
Tariff heading 8471.30.00 applies, invoice 2024/00817, 1,250 kg.
Paid 4,300.00 EUR on 12.03.2024 for lot L-5529.
The weather in Aberdeen delayed the vessel Queen Matilda by two days.
Theodora Blackwood§N and Lysander Moss§N share the desk of 3 Wharf Lane§A.
""".strip().split("\n")

KINDS = {"N": "name", "A": "address", "P": "phone", "E": "email", "I": "id_number"}
def labelled() -> list[tuple[str, set[tuple[int, str]]]]:
    """(text, {(start, type)}) of each line."""
    out = []
    for line in LINES:
        text, found = "", set()
        for part in re.split(r"(§[NAPEI])", line.replace("\\n", "\n")):
            if not part.startswith("§"):
                text += part
                continue
            m = next(k for k in range(len(text)) if text[k:] in _MENTIONS)
            found.add((m, KINDS[part[1]]))
        out.append((text, found))
    return out


_MENTIONS = set(
    "Michael Johnson|Sarah Williams|Robert Brown|12 Baker Street|1600 Pennsylvania Avenue|Wolfgang Schneider|+49 89 123456|w.schneider@speditionsued.de|912345678|0161 496 0732|elena@dock.example|Yuto Tanaka|yuto@tanaka.co.jp|"
    "Eleanor Whitfield|Tobias|claims-desk@northwind.co.uk|(020) 7183 8750|Abernathy|48 Juniper Crescent|219-09-9999|Priyanka Desai|221 Rosewood Lane|Beatriz Almeida|Gregory Pike|415-867-5309|415-867-5310|Baumgartner|Kastanienallee 17|86095742719|"
    "Annegret Vogt|C01X00T47|buchhaltung@kontor-lange.de|Lefèvre|27 rue Mouffetard|Margaux Perrin|06 12 34 56 78|Thierry Gaillard|14AB56789|compta@transports-morel.fr|Ignacio Quiroga|Calle Atocha 112|Ximena Bustamante|912 345 678|48392017K|"
    "pedidos@almacenes-rey.es|Charlotte Ainsworth|Harriet Osei|Winston Achebe|w.achebe@portlink.org|Pemberton|07700 900461|Ottoline Graves|+1 (312) 555-9088|Jarvis Holloway|9 Quarry Road|johnny dot appleseed at orchardmail dot com|27 483 910 226|Fitzgerald|"
    "MORGA753116SM9IJ|Seren Morgan|K. Lindqvist|RASMUSSEN, FREJA|Zdenka Horáková|1450 Maple Grove Drive|77 Cobblestone Court|Dominic|Felicity|Augustine|Edeltraud Seidel|Lindenstraße 5|Ludger Hüttermann|0221 / 9876543|8 bis, avenue des Tilleuls|"
    "Rafferty Quill|imogen tate|01632 960983|PERCIVAL STONE|0118 496 0123|QQ 12 34 56 C|Bronwyn Rees|yard_office@harbourside.net|01632 960 555|Theodora Blackwood|Lysander Moss|3 Wharf Lane".split("|")
)
