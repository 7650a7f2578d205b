"""Fixed inputs of the driver queries, with the results that their rules give by hand."""

#: Words and their stems, from the sample that was published with the Porter2 stemmer (fixed values).
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir
conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight
knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker
knocking knock knocks knock knopp knopp knot knot knots knot""".split()
STEM_SAMPLE = list(zip(STEMS[::2], STEMS[1::2], strict=True))

#: (source, spans): statements and comments with imports as one block, form feeds, a node cut at line ends, a block and a node cut hard; two sources that do not parse.
CODE = [
    ('"""Doc."""\nimport os\nX = 1\nimport sys\n\n\n@wraps\ndef f(a):\n    # inside\n    return a\n\n\n# alone\nclass C:\n    def g(self):\n        return 2\n', [(11, 37), (0, 10), (21, 26), (40, 82), (85, 92), (93, 135)]),
    ("# c\n\x0cdef f():\n    return 1\n\x0cclass A:\n    pass\n", [(0, 3), (5, 26), (28, 45)]),
    ("def f():\n" + "    x = 'abcdefgh'\n" * 60, [(0, 787), (788, 1148)]),
    ("".join(f"import module_number_{n:02}\n" for n in range(60)), [(0, 800), (800, 1439)]),
    ("x = '" + "a" * 1994 + "'", [(0, 800), (800, 1600), (1600, 2000)]),
    ("import os\nprint 'hello'\n\ndef f(a):\n    print a\n    # in\n# after\n\nx = 3  # note\n", [(0, 9), (10, 23), (25, 55), (56, 63), (65, 70), (72, 78)]),
    ("import os\nimport sys\n\ndef good():\n    return 1\n\ndef bad(:\n    x = (1,\n\nclass C:\n    def f(self):\n        return 2\n# end\n", [(0, 20), (22, 46), (48, 69), (71, 113), (114, 119)]),
]

#: Where the files of the corpus query lie, by their number's remainder: names that readers like to leave out, and one kind that is skipped.
PLACES = ["pkg/__init__{}.py", "_private/f{}.md", ".dot/f{}.txt", "a b%20/é {}.rst", ".hidden{}.md", "plain/f{}.png"]
