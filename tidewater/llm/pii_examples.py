"""The small labelled table that the personal-data model is trained on; all invented.

``[kind|words]`` marks a span.
"""

LABELLED = """
Contact [name|Jane Doe] for further details on this matter.
Please write to [name|Mr. Thomas Reed] before the end of May.
My name is [name|Laura Stone] and I live near the river.
The report was sent by [name|Dr. Anna Kessler] on Monday.
Yours sincerely, [name|Peter Hale]
Signed: [name|Maria Lopez]
Name: [name|Karl Weber]
Customer name: [name|Eve Martin]
Regards, [name|Oliver Grant]
Ask for [name|Ms. Carol Finch] at the desk.
Attn: [name|Henry Cole]
Call me at [phone|212-555-0147] tomorrow.
Phone: [phone|(415) 555-0101] or by post.
Tel. [phone|020 7946 0958] during the day
fax: [phone|555-0199] is also fine
Mobile [phone|0171 555 0123] after six.
You can reach us on [phone|312.555.0188] every day.
our number is [phone|(212) 555-0147]
phone [phone|555-0123], ask for the manager
tel: [phone|0301 234 5678]
SSN: [id|123-45-6789] is on file.
Her social security number is [id|987-65-4321] as stated.
ssn [id|219-09-9999]
Passport no. [id|X1234567] was issued last year.
Passport: [id|C01X0006H]
ID number [id|AB123456C] belongs to the tenant.
national id [id|QQ123456C]
Tax ID: [id|12-3456789] for the firm
write to [mail|jane (at) example (dot) com] please
mail me: [mail|tom at example dot org] any time
[mail|info [at] example [dot] net] is our address
email [mail|bob.smith at mail dot example dot com] today
contact [mail|anna at example dot de] or call
Please contact [name|Robert Lane] or [name|Susan Field] for a copy.
Dear [name|Mr. Hughes], thank you for your letter.
Dear [name|Mrs. Ellen Ward], we have received your form.
Dear [name|Dr. Paul Stein], the room is booked.
I spoke to [name|Ms. Grace Hill] about the lease.
We met [name|Mr. David Frost] and his wife at the gate.
The form was signed by [name|Alice Brook] in March.
It was written by [name|George Vale] and printed in London.
Sent by [name|Lucy Marsh] on behalf of the board.
Signed by [name|Martin Wolf], tenant.
Sincerely, [name|Nora Lund]
Best regards, [name|James Ford]
Kind regards, [name|Emma Shaw]
Yours, [name|Helen Price]
Name: [name|Frank Miller]
Full name: [name|Julia Hart]
Patient name: [name|Simon Peel]
My name is [name|Ivan Petrov] and I am the owner.
My name is [name|Clara Voss], I work at the school.
Her name is [name|Rita Gomez] as far as I know.
Attn: [name|Ms. Ruth Adler]
Attention: [name|Leo Brandt]
Ask for [name|Dr. Hugo Lenz] at the front desk.
Please write to [name|Mrs. Irene Cook] at the office.
Herr [name|Jonas Keller] hat den Brief gelesen.
Frau [name|Sabine Vogt] wohnt in der Nähe.
Madame [name|Claire Dubois] est la directrice.
Señor [name|Pablo Ruiz] vive en la ciudad.
Call me on [phone|202-555-0173] after lunch.
Call [phone|(303) 555-0111] to book a table.
Phone: [phone|404-555-0188]
Phone [phone|(617) 555-0166] for the keys.
Tel: [phone|0161 496 0321] from nine to five
Tel. [phone|030 901820] or by mail
telephone [phone|01632 960983] at any time
Mobile: [phone|0151 23456789]
mobile [phone|07700 900461] works best
Fax: [phone|212.555.0121]
You can reach me at [phone|(702) 555-0134] or at work.
our number is [phone|555-0142] as before
Reach us at [phone|(212) 555-0190], ask for the manager
SSN: [id|078-05-1120]
SSN [id|457-55-5462] was given on the form.
His social security number is [id|001-01-0001] it says.
social security no. [id|219-45-6789] on page two
Passport no. [id|L8988901C] is valid.
passport number [id|K1234567] of the traveller
Passport: [id|P7654321]
ID number [id|CD987654A] is wrong.
ID: [id|JK456789D]
national id [id|AB654321B] of the tenant
Tax ID: [id|98-7654321]
tax id [id|45-6789012] for the shop
write to [mail|paul at example dot com] or phone
write to [mail|lea (at) example (dot) org] please
mail me: [mail|kim at example dot net]
mail [mail|sara (at) example (dot) de] for more
email [mail|max at example dot org] today
email: [mail|office [at] example [dot] com]
contact [mail|news at example dot net] or call
send it to [mail|rosa.lee at example dot com] by May
[mail|help (at) example (dot) net] is our address
The river ran past the old mill as it always had.
In the year 1984 there were 120 people in the town.
It rained for 3 days and the wells were full again.
The Old Bridge was closed in March 2019 for repairs.
Version 2.0 of the license was released on 12-05-2004.
He counted 1,234 steps from the gate to the tower.
We met at the station at 10:30 and left at once.
Sie kamen am Morgen und gingen am Abend wieder.
Der Name der Rose ist ein Buch, das ich gern lese.
Les enfants jouaient dans la rue devant la maison.
El perro corre por la playa todos los dias.
Home | News | About | Contact
THIS IS NOT A NAME AND NOT A NUMBER
All rights reserved. Terms of use apply.
They were at home and the dot on the map was red.
a b c d e f g h i j
Look at the stars, said the man at the door.
The phone rang twice and then it stopped.
Call it what you like, the name is old.
Section 3-2 of chapter 12 covers this in 4 pages.
Prices rose by 12.5% in 2020 and by 3.1% in 2021.
Item 00123 and item 45-1 are out of stock.
Contact with water is to be avoided.
Please contact the office for a form.
Name and number are given below.
The signed form is kept by the office in Berlin.
Dear reader, thank you for the letter of May 12.
Dear Sir or Madam, the room is no longer free.
It was printed in London in 1902 and sold by the board.
Regards from the whole team in Madrid.
Call the office on Monday or write a letter.
The number is 42 and the year is 1969.
Her number was 7 and his was 12.
Take bus 555 to the gate, then walk 300 metres.
The table has 12 rows and 3456 cells, see 10-12.
A passport is needed, a form of ID is not.
The tax was 45 percent in 1990.
Serial no. 12345 and part no. AB12 are in the box.
See you at the gate at nine, write if not.
Meet at noon, at the dot of twelve.
An email or a letter is enough.
New York, Los Angeles and San Diego are large towns.
The Royal Society and the National Trust met in Oxford.
On Monday, Anna fell asleep. The next day it rained.
Ask for help when in doubt.
Das. Von der Ein
Was of. The and Then. That is For it.
It fell. Then rain came. Most left. Some stayed. All slept.
Once. Twice. More often. Never again. So it went. Enough.
Mill, Bridge, Tower and Station are old places.
Stone. River. Over there. Under it, Beside. Again it rained.
Row row row your boat, gently down the stream.
Never, never, never give in.
No, no, No. Stop, Stop there.
This work is licensed under the GNU General Public License, version 3.
The General Public Library and the Old Garden are open.
It ended. Rain fell on the Mill. Stone by stone it went.
River. Bridge. Tower. It was Over. Then Came rain.
Long ago. Ships came. Others left. Few stayed, Some slept.
Sehr, sehr, sehr weit. Immer Wieder.
was Was. Thing is. Was. Over and. From. Once. Her
CHAPTER ONE: THE LONG ROAD HOME
WARNING! HOT SURFACE! DO NOT TOUCH!
MANY PEOPLE CAME AND THEN. THEY WENT, AGAIN
Total: 40 % of 200 $ & tax, see page *12*.
* Milk * Bread * Eggs (large) # shopping
| Year | Sales | Profit |
Home > Products > Garden > Tools
def area(width, height): return width * height
if (Count > 0) { Total += Count; }
Who? What? When? Where? Why?
Red, Green, Blue, Yellow and Black were left.
Open Monday to Friday, closed on Sunday.
nothing's left-over; well, "so" (they) said: 'go'
Blätter fielen. Über Nacht kam Schnee. Öde lag das Land.
Él vino. Ñu corre. Así es. École. Être ici. À demain.
Über. Ähnlich Öl. Der Über Österreich. Été. Île. É.
von der Große. Der alte Über. Ünd, Éa, Ös
ACHTUNG! GLEIS DREI! ZUG FÄHRT EIN!
Der Zug nach Wien fährt um acht. Die Straße ist Gesperrt.
La Casa Vieja y el Río. ¡Hola! ¿Qué tal?
"""
