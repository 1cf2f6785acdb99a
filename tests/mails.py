"""Message files for the tests, written for this repository."""

ORDINARY = """\
Authentication-Results: in.library.example; dmarc=pass (p=NONE) header.from=outlook.com;
 dkim=pass header.d=outlook.com; spf=pass smtp.mailfrom=clerk@outlook.com
Received: from bk4.outbound.outlook.com (bk4.outbound.outlook.com [40.92.18.63])
 by in.library.example with ESMTPS id 7kq; Sat, 08 Nov 2025 18:21:47 +0100
Received: by bk4.outbound.outlook.com with SMTP id 7kp; Sat, 08 Nov 2025 18:21:09 +0100
Message-ID: <due-1204@outlook.com>
Date: Sat, 08 Nov 2025 18:21:02 +0100
From: Lending Clerk <clerk@outlook.com>
To: Member <member@library.example>
Subject: Two books are due
Content-Type: text/plain; charset="UTF-8"

Two of your books are due on Friday.
"""

SPOOFED = """\
Return-Path: <post@sender-hub.example>
Received: from hidden.proxy.example (unknown [92.118.39.17])
 by in.library.example with ESMTP id 9zt; Sun, 09 Nov 2025 03:40:12 -0500
Authentication-Results: in.library.example; dkim=fail; dmarc=fail (p=REJECT);
 spf=fail smtp.mailfrom=post@sender-hub.example
From: Savings Bank Notices <news@savings.example>
Reply-To: inbox@elsewhere.example
To: member@library.example
Date: Sun, 09 Nov 2025 03:39:31 -0500
Subject: Your card
Message-ID: <9zt@sender-hub.example>
Content-Type: text/plain; charset="UTF-8"

New terms: http://92.118.39.17/terms
"""


def injected(second="192.0.2.41", third="198.51.100.9"):
    return f"""\
Authentication-Results: in.library.example; dmarc=fail (p=REJECT); dkim=none;
 spf=fail smtp.mailfrom=a@parcel.example
Received: from node.rented.example (node.rented.example [77.91.84.5])
 by in.library.example with ESMTP id 2ab; Mon, 10 Nov 2025 06:15:30 +0900
Received: from depot.parcel.example (depot.parcel.example [{second}])
 by node.rented.example with ESMTP id 2aa; Mon, 10 Nov 2025 06:22:00 +0900
Received: from sorter.parcel.example (sorter.parcel.example [{third}])
 by depot.parcel.example with SMTP id 29z; Mon, 10 Nov 2025 06:23:15 +0900
From: Transit Desk <track@amazon.com>
To: member@library.example
Date: Mon, 10 Nov 2025 06:14:00 +0900
Subject: A parcel waits
Message-ID: <29z@rented.example>
Content-Type: text/plain; charset="UTF-8"

Pick a slot: http://parcel.example/slot
"""


SUBMITTED = """\
X-Originating-IP: [49.36.201.14]
Received: from out.clinic.example (out.clinic.example [49.36.201.14])
 by in.library.example with ESMTPS id 5mm; Tue, 11 Nov 2025 20:05:58 +0530
Received: from front-desk ([49.36.201.14]) by out.clinic.example with ESMTPSA id 5ml
 (authenticated as desk@clinic.example); Tue, 11 Nov 2025 20:05:41 +0530
Authentication-Results: in.library.example; dmarc=pass (p=NONE); dkim=pass;
 spf=pass smtp.mailfrom=desk@clinic.example
From: Clinic Desk <desk@clinic.example>
To: member@library.example
Date: Tue, 11 Nov 2025 20:05:40 +0530
Subject: Visit of Monday
Message-ID: <5ml@clinic.example>
Content-Type: text/plain; charset="UTF-8"

The visit comes to Rs 1,340 (INR 1,340.00 with the report).
Send it to clinic.front@ybl, or by transfer, code KKBK0004567.
Questions: 7012345678.
"""

CHAIN = """\
Received: from mail-a.google.com (mail-a.google.com [209.85.1.1])
        by mx.google.com with ESMTPS id i9; Tue, 02 Sep 2025 13:00:10 +0000
Received: from mail-b.google.com (mail-b.google.com [209.85.1.2])
        by mail-a.google.com with ESMTPS id j1; Tue, 02 Sep 2025 13:00:08 +0000
Received: from client.example (client.example [62.10.20.30])
        by smtp.gmail.com with ESMTPSA id k2; Tue, 02 Sep 2025 13:00:05 +0000
From: A <a@gmail.com>
To: reader@campus.example
Subject: Hello
Date: Tue, 02 Sep 2025 13:00:00 +0000

Hi.
"""

PRIVATE_SUBMISSION = """\
Received: from mail-a.google.com (mail-a.google.com [209.85.1.1])
        by mx.google.com with ESMTPS id i9; Tue, 02 Sep 2025 13:00:10 -0000
Received: from phone.lan ([10.1.2.3])
        by smtp.gmail.com with ESMTPSA id k2; Tue, 02 Sep 2025 13:00:05 +0000
From: A <a@gmail.com>
Subject: Hello

Hi.
"""

BARE = """\
X-Originating-IP: [62.10.20.30]
From: A <a@example.org>
Subject: No path

members, act now
"""

NO_FROM = "Subject: nothing else\n\nbody\n"

MULTIPART = """\
From: "Google Team" <info@other.example>
Reply-To: info@sub.other.example
Subject: Parts
Content-Type: multipart/mixed; boundary="b1"

--b1
Content-Type: text/plain; charset="utf-8"

See https://bit.ly/x and https://www.microsoft.com/en and https://shop.example/a
--b1
Content-Type: text/html; charset="utf-8"

<p><a href="https://shop.example/a">PayPal <b>login</b></a><a href="/rel">no</a></p>
--b1
Content-Type: application/octet-stream
Content-Disposition: attachment; filename="Run.EXE"
Content-Transfer-Encoding: base64

aGVsbG8=
--b1
Content-Type: application/octet-stream
Content-Disposition: attachment

--b1--
"""

ALL = {
    "01_ordinary.eml": ORDINARY, "02_spoofed.EML": SPOOFED, "03_injected.eml": injected(),
    "sub/04_submitted.eml": SUBMITTED, "05_public_injected.eml": injected("45.1.2.3", "46.1.2.3"),
    "06_chain.eml": CHAIN, "07_private_submission.eml": PRIVATE_SUBMISSION, "08_bare.eml": BARE,
    "09_no_from.eml": NO_FROM, "10_multipart.eml": MULTIPART, "11_copy.eml": ORDINARY,
}


def write(folder):
    for name, text in ALL.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (folder / "notes.txt").write_text("not a message")
    return str(folder)
