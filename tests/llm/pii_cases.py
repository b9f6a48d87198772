"""Sentences written and labelled by hand: personal data is marked as {kind|text}, everything else is none. The field's
forms were chosen with CASES in view; HELD_OUT was written afterwards and nothing was changed for it."""

CASES = """
Write to {email|john [dot] smith [at] mail [dot] org} for a copy.
Contact {email|j.doe [at] example [dot] com} or come by.
My address is {email|anna (at) web (dot) de}, I read it daily.
Mail: {email|support[at]shop.example}
Send it to {email|max dot muster at firma dot de} please.
{email|office (at) verein-nord (dot) example (dot) org} answers within a day.
Reach {email|maria_lopez [at] correo [dot] es} any time.
Ask {email|peter.b [at] uni [dot] ac [dot] uk} about the key.
Let us meet at example.com tomorrow.
We all look at Berlin.de first.
They work at acme.org since May.
Look at this. Then go home.
The file is at docs.example.net in the folder.
She arrived at 10.30 and left at 12.45.
Prices start at 4.99 dollars.
He scored at least twice. Dot the line at the end.
The cat sat at home [at least] today.
We met {email|via@mail.example.com} once.
Call {phone|0171 2345678} after six.
Tel. {phone|06 12 34 56 78} or leave a note.
Reach me on {phone|020 7946 0958} at work.
Mobile: {phone|07911 123456}.
Ring {phone|030/1234567} before noon.
Fax {phone|089 12345678} is off.
Phone: {phone|(555) 234-9876}
My number is {phone|555-234-9876}.
Dial {phone|415.555.2671} now.
The line {phone|+1 415 555 2671} is busy.
Use {phone|+44 20 7946 0958} from abroad.
Appelez le {phone|01.42.68.53.00} demain.
Das Büro hat {phone|040 1234567}, bitte anrufen.
Llame al {phone|+34 612 345 678} hoy.
Numéro : {phone|04 91 23 45 67}
Both {phone|+1 (269) 555-3296} {card|4524132264652876} are his.
Card {card|4111 1111 1111 1111} was used.
Card {card|4111.1111.1111.1111} was used twice.
She paid with {card|5500-0000-0000-0004} there.
Charge {card|378282246310005} please.
The IBAN is DE89 3704 0044 0532 0130 00 and stays.
Transfer to FR76 3000 6000 0112 3456 7890 189 today.
GB29 NWBK 6016 1331 9268 19 is the account.
Konto: ES9121000418450200051332
The order 4711 123456 was sent.
Invoice 2023-000123 is due on 2024-05-06.
ISBN 978-3-16-148410-0 is out of print.
ISBN 978 0 30 640615 7 is in stock.
On 2024-05-06 12:30:45 the job failed.
Between 1998 1999 2000 nothing grew.
The town has 1 234 567 people and 890 123 homes.
The number 4111111111111112 is no card.
Version 10.2.3 replaced 10.2.2 and 9.8.7.
Serial 00112233445566 is unknown.
Take 12 34 56 78 90 as a test.
Pi is 3.14159265358979 or so.
The code 0595765450607129 is wrong.
Coordinates 52.520008, 13.404954 mark it.
We sold 250000 in 2019 and 310000 in 2020.
Chapters 1. 2. 3. 4. follow.
Steps 1.) 2.) 3.) 4.) are done.
The host {ip|10[.]0[.]0[.]1} is up.
Block {ip|203 [.] 0 [.] 113 [.] 7} now.
It came from {ip|10 . 0 . 0 . 1} again.
Ping {ip|8.8.8.8} first.
Log: {ip|127[.]0[.]0[.]1} refused.
Section 1[.]3[.]6[.]1[.]4 is an object.
The mask 300[.]1[.]2[.]3 is none.
Hash 747e8edd6430861f24c6911d38d6f1 fits.
Paragraph 12.5.2019 was dropped.
A ratio of 1234567 to 7654321 holds.
Room 404-1234 is closed, floor 12.
Flight 370 left at 00:41 with 239 aboard.
Population 82 000 000 in 1990.
Tracking 1Z999AA10123456784 shows it.
""".strip().split("\n")

HELD_OUT = """
Please reply to {email|lena_k [at] post [dot] example [dot] net} soon.
Reports go to {email|audit.team (at) city (dot) gov}.
Spammers avoid {email|bob{at}site{dot}org}, it seems.
Mail {email|h dot weber at bahn dot de} with the ticket.
Questions: {email|info[at]garten[dot]ch}
We dined at Luigi.it last week.
The talk is at conf.example.org/2024 online.
Be there at noon. Com is a suffix.
Signed up at www.shop.example today.
Handy {phone|0151 23456789}, abends.
Anruf unter {phone|0221/9876543} genügt.
Standard téléphonique : {phone|01 44 55 66 77}
Office {phone|(0161) 4960123} closes at five.
Text {phone|07700 900123} for help.
Our fax is {phone|212-555-0187}.
Ruf {phone|+49 30 901 820} an.
Backup number {phone|(312) 555-0143}, ask for Joe.
Number {phone|650.555.0199} rang.
He typed {card|4012 8888 8888 1881} by mistake.
Refund {card|5105-1051-0510-5100} please.
Amex {card|3714 496353 98431} was declined.
Old card {card|6011111111111117} expired.
NL91 ABNA 0417 1643 00 is the account.
Account IT60 X054 2811 1010 0000 0123 456 was closed.
Paid from ES91 2100 0418 4502 0005 1332 in June.
Gateway {ip|172[.]16[.]254[.]3} dropped it.
Server at {ip|192.0.2.146} is slow.
Traffic from {ip|198 [.] 51 [.] 100 [.] 23} rose.
Release 4.19.0.1234567 broke it.
Range 2001 2002 2003 2004 was skipped.
Order 20240518-0042 shipped on 18/05/2024.
EAN 4006381333931 is on the box.
The sum is 12 345 678 euro.
Distance 384 400 km, mass 7342 10.
Log entry 1700000000 has no date.
Table: 15 22 37 41 58 60.
Case 14-cv-01234 was closed.
Latitude 48.858370, longitude 2.294481.
Scores were 3-2, 1-0 and 2-2 in 2022.
Build 20230911.4 passed 1893 of 1900 tests.
""".strip().split("\n")
