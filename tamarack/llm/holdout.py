"""Texts labelled by hand for quality.classify: 1 mostly list, table or machine residue, 0 prose. All invented. SEEDS train
along with the weak labels, CHECKED calibrates, MEASURED does neither and is what accuracy is measured on."""

CHECKED = (
    (0, "I tried the new planner for a week. It crashed twice and support told me to wait. Has anyone seen the same?"),
    (0, "we moved everything to the new tool last spring and honestly it has been fine apart from the reports which take forever to load and nobody can say why"),
    (0, "> The export never finishes.\nSame here. I gave up after an hour.\n> Did you try a smaller file?\nYes, it makes no difference at all."),
    (0, "Q: Can I get a refund?\nA: Yes, within two weeks of the order you can ask for one.\nQ: Who pays the fees?\nA: The fees are paid by us in most cases."),
    (0, "The meeting was moved to Friday because two of\nthe people who run the shop were ill, and the\nrest of us did not want to decide alone."),
    (0, "Der Export bricht jede Nacht ab, und niemand weiß warum. Wir haben den Support gefragt, aber es kam keine Antwort."),
    (0, "Depuis la mise à jour, la page reste blanche. Nous avons tout essayé, mais rien ne change pour les clients."),
    (0, "Desde la última versión no podemos imprimir las etiquetas. El soporte dice que es normal, pero no lo es."),
    (0, "[POST] Search is slow\nu/someone: It takes a minute for me as well.\nu/other_one: I switched to another tool in the end.\n-- reply: Which one did you pick?"),
    (0, '"It never worked for me." (comment, score 12)\n"We had to pay for the larger plan to get it." (post, score 88)\n"I would not buy it again." (comment, score 4)'),
    (0, "I like how simple it is. Here is what I would change:\n- a dark theme\n- faster search\nApart from these two points I am happy with it and so are the people in our office."),
    (0, "its teh third time this hapens to me and i dont know waht to do , plz help becuase my boss is getting angry with me"),
    (0, "## Problem\n\nOwners of small shops lose time with the monthly report. They export it by hand and fix the totals in a spreadsheet.\n\n## Who feels it\n\nMostly people without an accountant."),
    (0, "We compared five tools before we chose this one. The price was fair and the setup took a day. After a month the first invoice was wrong, and then every second one. The log said:\n\n    error 12 in total()\n\nI sent it to them and never heard back."),
    (0, "Thanks."),
    (0, "It works for me now."),
    (1, "- dark theme\n- faster search\n- price list\n- bulk import\n- better export\n- stock counter"),
    (1, "1. price list\n2. photo gallery\n3. waiting list\n4. map of routes\n5. dark theme\n6. chat"),
    (1, "| item | count | share |\n|---|---|---|\n| search | 12 | 0.4 |\n| export | 9 | 0.3 |\n| theme | 4 | 0.1 |"),
    (1, "search;12;0.4;yes\nexport;9;0.3;no\ntheme;4;0.1;yes\nmap;3;0.1;no"),
    (1, "Home\nPricing\nBlog\nLog in\nSign up\nTerms\nCookie settings\nAccept all\nNext page\nBack to top"),
    (1, '<div class="a1"><span data-id="12">&nbsp;</span></div><div class="a2"><span data-id="13"></span></div>'),
    (1, '[{"id": 12, "kind": "t3", "score": 4}, {"id": 13, "kind": "t1", "score": 9}, {"id": 14, "kind": "t1", "score": 2}]'),
    (1, "00000000  33 99 2a 05 51 24 36 41 c8 8a cf 89 88 e9 33 cb\n00000010  41 ba 1b 01 fa 18 6c a5 7c 60 a5 35 66 68 e4 d2"),
    (1, "Traceback:\n  at a.run(line 304) 0x7b8f8b9c95\n  at b.emit(line 1903) 0x3249afcc4f\n  at c.load(line 957) 0x9e63d378c9"),
    (1, "same\nsame\nsame\nsame\nsame\nsame\nsame\nsame\nsame\nsame"),
    (1, "haaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    (1, "Ã¤Ã¶Ã¼ â€œÂ§Â± Â¶Â©â€™ Ã¿Â¢ â€žÂ¼Å¸ Â±Â¶ Å“Å¾ Â§Â§ Ã¢Ã¢ Â¢Â¢"),
    (1, "fixed: search (#12)\nadded: dark theme (#88)\nremoved: old map (#91)\nchanged: export of invoices (#104)"),
    (1, "dark theme | search box | the export of invoices | price list for teams | the waiting list | chat on mobile"),
    (1, "Things to check before the call:\n- [ ] search\n- [x] the export page\n- [ ] price list v2\n- [ ] the dark theme\n- [x] chat by role"),
    (1, "die Suche; der Export; die Preisliste; das Formular; die Suche; der Export; der Bericht; die Sicherung"),
    (1, "the scan screen v2\nthe reset link\ncalendar sync\nthe delivery map by role\nthe document preview\nthe picture gallery"),
    (1, "2024-01-03 12:00:01 INFO worker=3 queue=7 retry=0\n2024-01-03 12:00:02 WARN worker=4 queue=9 retry=1\n2024-01-03 12:00:05 INFO worker=3 queue=2 retry=0"),
    (1, "SELECT a, b FROM t WHERE c = 4;\nSELECT d FROM u WHERE e IN (1, 2, 3);\nUPDATE t SET a = 0;"),
)

SEEDS = (
    (0, "The river rose in the night and by morning the lower road was gone. We carried what we could up the hill and waited for the boats."),
    (0, "my sister asked me to fix her printer again and i said no because last time it took the whole weekend and she never even said thank you"),
    (0, "Wir haben den Vertrag gekündigt, weil die Rechnung jeden Monat höher war als vereinbart. Der Anbieter hat sich nie gemeldet."),
    (0, "Q: Does it work offline?\nA: It does, but only for the files that you opened while you were online."),
    (0, "He said that the old version was better, and I think he is right about that.\nThe new one hides half of what we need behind menus."),
    (1, "apples\npears\nbread\nmilk\ncoffee\nsoap\nbatteries"),
    (1, "id,name,price,stock\n1,lamp,12.50,4\n2,chair,49.00,0\n3,desk,120.00,7"),
    (1, "<ul class=\"nav\"><li><a href=\"/a\">A</a></li><li><a href=\"/b\">B</a></li></ul>"),
    (1, "ERROR 2031 at 0x7fa3c1 in mod_cache.so (+0x1f3)\nERROR 2031 at 0x7fa3d9 in mod_cache.so (+0x20b)"),
    (1, "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Q5ODc2NTQzMjEwYWJjZGVmZ2hpamtsbW5vcA=="),
    (0, "Nobody told us that the bridge was closed, so we waited there with the whole load until it got dark."),
    (0, "we tried it twice and it was slow both times but at least it did not lose anything which is more than i can say for the other one"),
    (0, "Ich war gestern dort, und es war niemand da. Am Telefon hieß es, man habe uns vergessen."),
    (0, "[POST] Boots fall apart\n-- reply: Mine did too, after one winter. They sent me a new pair and that one lasts."),
    (0, "Thank you so much!"),
    (0, "They wrote to say that it would be fixed. That was in May. Here is what is still open:\n- the door\n- the lamp\nI will ask again next week and tell you what they say."),
    (1, "lamp;3;0.2;yes\nchair;8;0.5;no\ndesk;1;0.1;yes\nstool;2;0.1;no"),
    (1, "size\tprice\tleft\nsmall\t2.50\t14\nlarge\t4.75\t3\nhuge\t9.00\t0"),
    (1, "blue lamp | oak chair | the small desk | kitchen stool | folding bed | garden bench | mirror"),
    (1, "der Tisch; die Lampe; der Stuhl; das Regal; die Lampe; der Schrank; das Bett; der Tisch"),
    (1, "Shopping for the trip\noak chair (new), blue lamp, two stools, the folding bed, garden bench, mirror, rug, curtain rod, door mat"),
    (1, "[{\"k\": 1, \"v\": \"a\", \"w\": null}, {\"k\": 2, \"v\": \"b\", \"w\": null}, {\"k\": 3, \"v\": \"c\", \"w\": 0.5}]"),
    (1, "Ã¼Â¤ â€\x9cÃ¶ Â¶Â§ Ã\x9fÂ© â€™â€™ Ã¢â‚¬ Â±Â± Â°Ã¤ Ã´Ã» Å’Å¡ Â¼Â½"),
    (1, "INSERT INTO t (a, b) VALUES (1, 'x');\nSELECT a FROM t WHERE b = 'x' ORDER BY a;\nDROP TABLE t;"),
    (1, "1) oak chair\n2) blue lamp (new)\n3) kitchen stool\n4. folding bed for guests\n5. garden bench"),
    (1, "- [ ] oak chair\n- [x] blue lamp\n- [ ] the kitchen stool v2\n- [x] folding bed\n- [ ] mirror"),
    (1, "Menu Home Shop Cart Sign in Help Terms Privacy Home Shop Cart Help Accept all Next Back to top Share Home Cart"),
    (1, "push the button push the button push the button push the button push the button push the button push the button"),
    (1, "#oakchair #bluelamp #kitchenstool #foldingbed #gardenbench #mirror #rug"),
)

MEASURED = (
    (0, "After the storm the power was out for two days. Nobody from the company called us back, so we drove to the office and found it closed."),
    (0, "I grew up in a house without a telephone, and when we finally got one my grandmother refused to touch it. She wrote letters until she died."),
    (0, "so basically what happens is you press save and nothing, no message no sound, then an hour later it is all gone and you start over"),
    (0, "The committee met three times this year.\nEach time the question of the roof came up, and each time it\nwas put off, because the money had gone to the\nheating instead."),
    (0, "> Why did you leave the old bank?\nThey closed the branch in our town and wanted me to do it all by phone.\n> And now?\nNow I bring the cash to the post office."),
    (0, "Il pleut depuis trois semaines et le jardin ressemble à un lac. Mon voisin dit que c'est normal, mais je n'ai jamais vu cela."),
    (0, "Ayer fuimos al mercado y no había nada. La señora de la esquina nos dijo que los camiones no llegan desde el lunes."),
    (0, "Der Zug fiel aus, und der nächste kam erst nach einer Stunde. Niemand am Bahnhof wusste, was los war."),
    (0, "We baked it for an hour and it was still raw inside. What I would change next time:\n- a smaller tin\n- less water\nThe taste was good though, and the children ate all of it before it was cold."),
    (0, "The function returns nothing when the list is empty, which took me a day to find out. I would write:\n\n    if not items:\n        return 0\n\nThat is all it takes, and I wonder why nobody did it before."),
    (0, "teh docter sed it wil get beter in a few weaks but its been too months now an i stil cant lift my arm"),
    (0, "Interviewer: How long did you work there?\nBaker: Thirty years, from the day I left school until the oven broke.\nInterviewer: Did you like it?\nBaker: On most days I did."),
    (1, "* tent\n* two sleeping bags\n* stove and gas\n* water filter\n* first aid kit\n* map\n* rope, 20 m"),
    (1, "Mon 08:00 swim\nMon 17:30 choir\nTue 09:00 dentist\nWed 18:00 chess\nThu 07:45 bus\nFri 20:00 film"),
    (1, "Year | Wheat | Rye | Oats\n1901 | 12.1 | 8.4 | 6.0\n1902 | 11.7 | 8.9 | 6.2\n1903 | 13.0 | 7.7 | 5.9"),
    (1, "red, blue, dark green, light green, yellow, off-white, grey, brown, orange, purple, black, pale pink, silver"),
    (1, "GET /a/b.css 200 12ms\nGET /a/c.js 304 3ms\nPOST /login 302 48ms\nGET /home 200 91ms\nGET /img/logo.png 200 7ms"),
    (1, "{\"a\": [1, 2, 3], \"b\": {\"c\": null, \"d\": [true, false]}, \"e\": \"x1\", \"f\": 0.25, \"g\": []}"),
    (1, "def f(x):\n    return x + 1\n\nfor i in range(10):\n    print(f(i), i ** 2)\n\nclass A(B):\n    pass"),
    (1, "xxxxxxxx xxxxxxxx xxxxxxxx xxxxxxxx xxxxxxxx xxxxxxxx xxxxxxxx xxxxxxxx"),
    (1, "Startseite\nProdukte\nÜber uns\nKontakt\nImpressum\nDatenschutz\nAnmelden\nWarenkorb (0)"),
    (1, "7f 45 4c 46 02 01 01 00 00 00 00 00 00 00 00 00 03 00 3e 00 01 00 00 00 40 10 00 00 00 00 00 00"),
    (1, "https://one.example/a\nhttps://one.example/b\nhttps://two.example/c\nhttps://three.example/d?x=1&y=2"),
    (1, "â€œ Ã© Ã¨ Ã  Ã§ Ãª Ã® Ã´ Ã» â€\x9d â€™ Â« Â» Â° Ã¼ Ã¶ Ã¤ ÃŸ"),
)
