"""The small labelled table of the personal-data field, and lines held out to measure it. Fixed values.

One line per row in English, German, French or Spanish; spans are marked as [KIND text]. All lines are
made up.
"""

TRAINING = """
call me at [local_phone 555-123-4567] tonight
phone: [local_phone (555) 123-4567]
tel [local_phone 555.867.5309] ext 12
my mobile is [local_phone 0171 2345678] thanks
Tel.: [local_phone 030/1234567]
fax [local_phone (020) 7946 0958] or write
mobile number [local_phone 06 12 34 56 78] please
reach us by phone on [local_phone 212-555-0199] after six
phone [local_phone 415 555 2671] is the desk
cell: [local_phone (408) 555-1212] home
Telefon [local_phone 089 4455667] ab acht
Handy: [local_phone 0151 23456789] oder Mail
Rufnummer [local_phone 0221/998877] im Haus
téléphone : [local_phone 01 42 68 53 00] le matin
tél. [local_phone 04.91.22.33.44] ou ici
portable [local_phone 07 81 22 43 65] merci
teléfono: [local_phone 91 123 45 67] por la tarde
móvil [local_phone 612 345 678] gracias
llame al teléfono [local_phone 934 567 890] hoy
ssn [identity 123-45-6789] on file
social security number: [identity 987-65-4321]
the SSN is [identity 078-05-1120] they said
SSN: [identity 219-09-9999]
national id [identity 111-22-3333] was sent
the identity number [identity 456-78-9012] is there
passport no. [identity 533401287] was lost
passport number [identity 880127431] and visa
Personalausweis Nr. [identity 220001297] gültig
Steuernummer [identity 12345678901] angeben
Reisepass [identity 470123985] verloren
numéro de sécurité sociale [identity 1 85 05 78 006 084 36] noté
passeport [identity 142367885] perdu
DNI [identity 12345678] del titular
pasaporte [identity 305771246] caducado
iban [account DE89 3704 0044 0532 0130 00] bank
IBAN: [account GB82 WEST 1234 5698 7654 32]
account [account FR14 2004 1010 0505 0001 3] paid
pay to IBAN [account ES91 2100 0418 4502 0005 1332] now
account number: [account 12345678] at the bank
acct [account 000123456789] closed
bank account [account 9876543210] holds it
Konto [account 532013000] bei uns
Kontonummer: [account 1234567890] Bank
compte [account 00012345678] de la banque
compte bancaire [account 30001007941234567890185] fermé
cuenta [account 21000418450200051332] del banco
número de cuenta: [account 0200051332] pagado
born on [birth_date 12/05/1981] in the north
date of birth: [birth_date 1975-11-30]
birthday [birth_date 03.07.1990] this year
DOB [birth_date 04-09-1966] checked
born [birth_date 17 March 1958] at home
geboren am [birth_date 24.12.1970] in Ulm
Geburtsdatum: [birth_date 01.02.1984] und
geb. [birth_date 5. Mai 1969] dort
née le [birth_date 14/07/1989] ici
né le [birth_date 3 mars 1961] à Lyon
date de naissance : [birth_date 22/10/1995]
nacido el [birth_date 08/03/1979] en
nacida el [birth_date 19 de abril de 1983] aquí
fecha de nacimiento: [birth_date 30-06-1992]
Dear Mr. [person John Baker], we write
Mrs [person Alice Monroe] will come
ask Dr. [person Helen Ortiz] about it
Ms. [person Joan Pike] signed
Mr [person Hale] and others left
patient name: [person Robert Lang]
Herr [person Peter Schmidt] kommt heute
Frau [person Anna Keller] hat es
Name: [person Karl Weber] aus der Stadt
Monsieur [person Jean Dupont] est là
Madame [person Claire Moreau] arrive
Mme [person Durand] signera demain
señor [person Luis Romero] llega
señora [person Carmen Vidal] firma
nombre: [person Pedro Alonso] del barrio
lives at [address 12 Maple Street] since then
office: [address 240 West Road] second floor
at [address 7 Park Avenue] near the sea
address: [address 98 Hill Lane] door two
wohnt in der [address Gartenstraße 14] seit Mai
Adresse: [address Lindenweg 3] im Hof
am [address Marktplatz 22] in Köln
habite [address 15 rue Victor Hugo] depuis
adresse : [address 8 avenue Foch] au fond
vive en la [address calle Mayor 27] desde
dirección: [address avenida Goya 105] piso dos
in 1999 we sold 250 units
the price is 19.99 or 24.50 today
version 3.11.2 was out on 2024-05-17
see chapter 12, page 345, line 6
on 12/05/2021 at 10:30 they met
order 1234567 shipped with 3 boxes
room 101 and room 202 are free
it took 15 minutes and 30 seconds
a run of 1000000 steps over 24 hours
the ratio is 0.75 for 80 of them
id 42 row 17 col 3
from 1914-1918 to 1939-1945
score 3-2 in game 7
the 4111111111111111 card is theirs
at 192.168.1.10 port 8080
word1 word2 word3
about 10 - 12 people and 5.5 km
mp3 files of 320 kbps
figure 2.1 and table 3.4
the 21st of May 2020
total: 1,234,567.89 euros
ratio 16:9 at 1920x1080
isbn 978-3-16-148410-0 in print
build 20240517 passed 12 of 12
sha 64be90d2c7f3 commit
checksum = d41d8cd98f00b204 of file 7
Im Jahr 1871 waren es 41 Orte
Seite 88, Zeile 4, Band II
um 18:45 Uhr am 3. Oktober 1990
en 1789 il y avait 26 villes
le prix est de 12,50 euros, page 9
el 14 de abril de 1931 hubo 3 actos
son las 10:30 del 2 de mayo
The North. In the end we left. There was rain
Die Stadt. Der Wald und das Meer. Es war kalt
La mer. Le vent et la pluie. Il fait beau
El mar. La casa y el camino. No hay nadie
the account of the journey is long
we call it a day and name no one
the bank of the river in Spring
die Bank am Fluss ist alt
the street was empty and the road was wet
a phone and a mobile stood there
the identity of the two sums holds
born of fire and of water
it was a quiet morning and the people of the town went slowly to the market with their baskets
She said that nobody had seen the boat since the storm, and that the harbour was closed for now.
We walked along the river until dark; then the lamps were lit and a band began to play.
There is no reason to think that the old bridge, built of stone, would not hold another winter
After the meeting they agreed on a plan. Nothing was written down. Everyone left early.
what we know of the plan comes from letters, notes, and a few short articles in the press
"Come in," they said, "and close the door." The room was warm; a cat slept by the stove.
es war ein ruhiger Abend und die Kinder spielten noch lange im Garten hinter dem alten Haus
Niemand wusste, woher der Wind kam, aber alle hörten ihn durch die leeren Gassen ziehen.
Die Bauern brachten das Heu ein, bevor der Regen fiel; danach saßen sie in der Stube.
Man sagt, dass der Fluss früher breiter war und dass Schiffe bis zur Mühle fahren konnten
le soir tombait sur la plaine et les oiseaux se taisaient un à un dans les arbres
Personne ne savait pourquoi la porte était ouverte, ni qui avait laissé la lampe allumée.
Les enfants couraient vers la plage ; leurs parents marchaient plus lentement derrière eux.
on raconte que la rivière était plus large autrefois et que des bateaux montaient ici
la tarde era tranquila y los vecinos hablaban en voz baja delante de la iglesia
Nadie sabía de dónde venía el viento, pero todos lo oían pasar por las ventanas.
Los pescadores volvían temprano; sus redes estaban llenas y el puerto olía a sal.
se dice que el río era más ancho antes y que los barcos llegaban hasta el molino
*** ### &&& word | other | third | fourth | fifth ||| -- ++ == %% $$ ~~ [x] {y} <z>
a, b, c; d: e / f - g (h) i! j? k... "l" 'm' n_o p#q r@s
END OF PART ONE. NO WARRANTY IS GIVEN. ALL RIGHTS ARE RESERVED BY THE OWNERS.
The software is provided as is, without warranty of any kind, express or implied, to any user.
In Spring the Old Mill opens. The Guild of Weavers meets there. So do the Millers of Upper Dale.
there were 12 of them, then 7, then only 3 by the end of the week, and 2 came back
"""

HELD_OUT = """
please call [local_phone 646-555-0142] before noon
Tel: [local_phone (212) 555-7788] day and night
mobile: [local_phone 0160 9876543] evenings
Telefon: [local_phone 040 7654321] bitte
téléphone [local_phone 05 56 11 22 33] svp
teléfono [local_phone 95 765 43 21] oficina
SSN [identity 321-54-9876] on record
social security number [identity 612-33-4455] missing
passport number: [identity 771203345] expired
Reisepass Nr. [identity 901234567] neu
passeport : [identity 660812334] rendu
IBAN [account GB29 NWBK 6016 1331 9268 19] please
account number [account 87654321] is open
Konto: [account 7788990011] gesperrt
cuenta [account 0182123456] nueva
born on [birth_date 23/08/1977] near here
date of birth: [birth_date 1988-02-14]
geboren am [birth_date 09.11.1989] in Jena
née le [birth_date 02/12/1964] à Nice
fecha de nacimiento: [birth_date 15-01-2001]
Dear Mrs. [person Emma Stone], thank you
Dr. [person Alan Reed] is in
Herr [person Jonas Vogel] wartet
Madame [person Sophie Lambert] parle
señor [person Diego Castro] vuelve
lives at [address 45 Oak Street] with two dogs
address: [address 310 River Road] rear
Adresse: [address Bergstraße 9] links
habite [address 23 rue Pasteur] ici
dirección: [address calle Real 41] bajo
in 2008 they built 14 bridges
meet on 03/04/2019 at 09:15 sharp
invoice 7654321 for 12 items
the file has 2048 rows and 16 columns
version 10.4.1 of 2023-09-30
pages 12-15 and 101-104
about 3.5 km in 40 minutes
am 12. Juni 2015 um 20:15 Uhr
il y a 365 jours en 2021
el 5 de junio de 1999 eran 40
The wind. After that it rained. No one came
Der Zug kam. Die Leute gingen. Alles war still
the account was true and the bank was steep
"""
