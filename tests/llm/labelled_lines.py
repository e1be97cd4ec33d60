"""Lines written and labelled by hand: {e:..} an email address, {i:..} an ip address, {c:..} a card number, {p:..} a phone
number.  None was made by the generator that the field learns from."""

LINES = r"""
Please send the signed form to {e:ana.torres@clinic-west.org} before Friday.
You can reach me on {p:+44 20 7946 0958} most mornings.
The server at {i:192.168.14.7} stopped answering around noon.
Card on file: {c:4111 1111 1111 1111}, expires next spring.
My new number is {p:(212) 555-0147}, please update your notes.
Rechnung bitte an {e:buchhaltung@mueller-soehne.de} schicken.
Ping from {i:10.0.0.254} took 3 ms on average.
Chapter 3.2.1 explains the method in more detail.
The meeting moved to 14:30 in room 5.114.
She paid 1,249.99 for the bicycle and 35.50 for the lock.
Order 20240311-77 was shipped on 2024-03-12.
Contact: {e:j.doe+lists@example.co.uk} or {p:+1 (415) 555-2671}.
Version 10.4.2 fixes the crash on start.
He scored 21-19, 18-21 and 21-15 in the final.
ISBN 978-3-16-148410-0 is out of print.
Refund went to {c:5555-5555-5555-4444} two days ago.
Appelez le {p:+33 1 42 68 53 00} pour confirmer.
Write to {e:support(at)smallshop.net} if the parcel is late.
The router's address is {i:172.16.254.1}, the gateway's is {i:172.16.254.254}.
Flight LH 455 leaves at 17:05 from gate B22.
Latitude 48.8566, longitude 2.3522, give or take.
We counted 3,450 visitors in the first 12 weeks.
Amex {c:378282246310005} was declined twice.
Mi correo es {e:lucia_fernandez88@correo.es}, gracias.
tel. {p:030 901820} (Zentrale)
The recipe needs 250 g flour, 3 eggs and 125 ml milk.
Set the DNS to {i:8.8.8.8} and {i:8.8.4.4}.
Serial number 1234 5678 9012 3456 is printed on the back.
Invoice no. 4929-0012 of 03.04.2023
Fax {p:+49 89 636-48018}, attention Ms Weber.
The temperature fell from 21.5 to -3.2 overnight.
Send a copy to {e:legal@northwind.example} and {e:ceo@northwind.example}.
Her extension is 4471.
The 1990s and 2000s saw 3 recessions.
Access from {i:203.0.113.45} was blocked at 02:14:59.
Call {p:1-800-555-0199} toll free.
card={c:6011111111111117};cvv=123
Bring 2 copies of form I-90 and USD 540.
Please dial {p:+61 2 9374 4000} and ask for reception.
The address {e:o'neil.p@irish-mail.ie} bounced.
Kontakt: {e:redaktion@tagblatt.ch}, {p:+41 44 668 18 00}
Room 101, floor 3, building 27.
Model XR-4500B weighs 12.75 kg.
The hash began with 9f86d081884c7d65.
Log: {i:66.249.66.1} - - [10/Oct/2000:13:55:36] "GET /"
My old card {c:4012 8888 8888 1881} has expired.
On page 217 there are 4 figures and 2 tables.
It costs 19.90 a month for 24 months.
Text {p:+91 98765 43210} after six.
Ask {e:helpdesk@uni-heidelberg.de} for an account.
The ratio is 16:9, the resolution 1920x1080.
Subnet mask 255.255.255.0 belongs to {i:192.0.2.33}.
Population: 8,336,817 (2019 estimate).
Pay with {c:3530 1113 3330 0000} if the other fails.
The bus number 42 leaves every 15 minutes.
Whoever finds it: {e:lost.dog.rex@petmail.com}, {p:555-0123}.
Train 1127 arrives on platform 7b at 08:09.
The score was 104 to 98 after overtime.
Tracking 1Z 999 AA1 01 2345 6784 says delivered.
Our VAT number is DE 811907980.
{p:+1-202-555-0173} is the press office.
The peer {i:198.51.100.77}:6881 sent garbage.
Use {e:first.last@sub.domain.example.com} for tests.
Paragraph 2.4.1.7 was repealed in 1998.
Between 1914 and 1918 the price rose by 214 percent.
IBAN DE89 3704 0044 0532 0130 00
He ran 10 km in 42:17 and 5 km in 19:58.
Visa {c:4222222222222} is a test number.
Please call {p:020 7946 0018} or come by.
The account {e:root@localhost.localdomain} cannot receive mail.
Windows 3.1.1 and OS/2 2.0 were compared.
Her desk phone: {p:(089) 1234-567}
The invoice total is EUR 12.345,67.
Diners {c:30569309025904} is accepted here.
The last digit of 7919 is 9.
Whitelist {i:100.64.0.12}, {i:100.64.0.13} and {i:100.64.0.14}.
Mail me - {e:k.j.w@zeta-labs.io} - or write a letter.
Born 12/05/1987 in Lyon.
SELECT * FROM t WHERE id = 400123 LIMIT 50
{e:Newsletter@Shop24.COM} sends too much.
Numéro vert: {p:0 800 12 34 56}
We met at 7.30 pm on 3 March 2015.
PIN 4821 must never be shared.
Mastercard {c:5105 1051 0510 5100}, name as on the card.
Section 4, lines 17 to 29, is new.
The host {i:127.0.0.1} is always local.
In 2.5.0.1 of the tool the flag is gone.
{p:+86 10 6552 9988} rings in Beijing.
Lot 20230815 expires 08/2026.
The engine makes 150 hp at 5,500 rpm.
Questions go to {e:info@museum-of-clocks.org.uk}.
He typed {c:4000056655665556} into the form.
Answer within 14 days, see article 17.
Her mobile ({p:07700 900461}) was off.
Phase 2 has 48 patients in 6 centres.
Reboot {i:10.20.30.40} at 03:00.
The equation 3x + 4y = 12 has many solutions.
Use code SAVE20 before 31.12.
The file has 1048576 bytes.
Write {e:a@b.co} for short.
Emergency: 112 or 911.
{p:+34 91 521 29 00}, lunes a viernes
Ticket #88213 was closed by the bot.
The asteroid 433 Eros was found in 1898.
Deliver to unit 4/12, postcode 3000.
Two cards: {c:6011000990139424} and {c:371449635398431}.
The sky was clear and nobody called.
A list: 1, 2, 3, 5, 8, 13, 21, 34, 55, 89.
Try {e:someone.else@mail.example.org}; the first one is full.
10.1000/182 is a DOI.
Cluster nodes {i:10.1.1.1} to {i:10.1.1.9} were patched.
Our landline is {p:01632 960983}.
Heights of 1.62, 1.75 and 1.81 m
Phone/Fax: {p:+39 06 6982 1234}
Balance: -120.00, limit 2,000.00
The pH fell from 7.4 to 6.8 in 20 minutes.
Zip code 90210-1234
Sent from {e:marta@home.pl} on my phone
Chip card {c:5200828282828210} was cloned.
See RFC 2616, section 14.9.3.
Dose: 0.5 mg/kg, max. 40 mg a day.
{e:team-leads@very-long-company-name-gmbh.example} is a list.
The door code changed to 7713#.
Rank 3 of 1,204 players.
The switch answers on {i:169.254.10.10} only.
Give my best to everyone in class 4b.
Call back: {p:+353 1 679 5000} ext. 12
The 12 apostles, the 7 sins, the 4 seasons.
UTC+2 from 31 March to 27 October.
The card ending 1881 was charged 60.
{e:x.y-z_1@d-e.f-g.org}
Her blog has 1.2 million readers.
Copy {e:p.r@office.example}, not {e:pr@office.example}.
{c:2223003122003222} is of the new range.
Ring {p:+7 495 739 70 00} between 9 and 5.
The pump moves 4.5.6 is not a number.
Kennzeichen M-AB 1234, Fahrgestell WVWZZZ1JZXW000001
Blocked: {i:45.33.32.156} (scan), {i:185.220.101.1} (exit)
""".strip().split("\n")


def parsed(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """(text, [(kind, start, end)]) of a line."""
    kinds, text, spans, at = {"e": "email", "i": "ip", "c": "card", "p": "phone"}, "", [], 0
    while (begin := line.find("{", at)) >= 0:
        end = line.index("}", begin)
        text += line[at:begin]
        spans.append((kinds[line[begin + 1]], len(text), len(text) + end - begin - 3))
        text += line[begin + 3 : end]
        at = end + 1
    return text + line[at:], spans
