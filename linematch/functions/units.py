"""Unit spellings and what they stand for."""

from __future__ import annotations

#: The spellings that the line parser knows, by canonical unit.
ASCII_UNITS = {
    "kg": ["kilograms", "kilogram", "kgs", "kg"],
    "g": ["grams", "gram", "gms", "gm", "g"],
    "liter": ["litres", "litre", "liters", "liter", "l"],
    "ml": ["millilitres", "millilitre", "milliliters", "milliliter", "ml"],
    "piece": ["pieces", "piece", "pcs", "pc"],
    "packet": ["packets", "packet", "packs", "pack", "pukat", "puket", "paket"],
    "box": ["boxes", "box"],
    "bottle": ["bottles", "bottle", "bot"],
    "dozen": ["dozen", "doz"],
    "bag": ["theli", "thelee", "bags", "bag", "bori"],
}
GUJARATI_UNITS = {
    "kg": ["કિલોગ્રામ", "કલોગ્રામ", "કિલોગરામ", "કિગ્રા", "કિ.ગ્રા.", "કિલો", "કીલો", "કલો", "કલા", "કિલા", "કલો."],
    "ml": ["મિલીલીટર", "મિલીલિટર", "મીલીલીટર", "મિલિ", "મીલી"],
    "g": ["ગ્રામ", "ગરામ", "ગ્રા", "ગ્રા."],
    "liter": ["લિટર", "લીટર", "લટિર", "લટર", "લીટિર", "લીટર.", "લિટર."],
    "piece": ["નંગો", "નંગ", "નગ", "પીસો", "પીસ"],
    "dozen": ["ડઝન", "ડજન"],
    "packet": ["પેકેટ", "પેક"],
    "bag": ["થેલીઓ", "થેલી", "કોથળીઓ", "કોથળી", "બોરી"],
    "bottle": ["બોટલ", "બોતલ"],
    "box": ["બોક્સ", "બોકસ"],
    "rupee": ["રૂપિયા", "રૂ."],
}
HINDI_UNITS = {
    "kg": ["किलोग्राम", "किलो", "कलि", "किग्रा"],
    "ml": ["मिलीलीटर", "मिली"],
    "liter": ["लीटर", "लिटर"],
    "g": ["ग्राम", "ग्रा"],
    "piece": ["नंग", "पीस"],
    "dozen": ["दर्जन"],
    "packet": ["पैकेट", "पैक"],
    "bag": ["थैली"],
    "bottle": ["बोतल"],
    "box": ["डिब्बा"],
}


def spellings(*tables: dict[str, list[str]]) -> dict[str, str]:
    """Spelling to canonical unit, in the order given."""
    return {word: unit for table in tables for unit, words in table.items() for word in words}


#: What the line parser accepts (ASCII spellings in any case).
PARSER_UNITS = spellings(ASCII_UNITS, GUJARATI_UNITS, HINDI_UNITS)

#: Further spellings met in the sources, used where amounts are converted.
MORE_UNITS = {
    "kg": ["kgms", "kgm", "kilo", "kilos", "k.g.", "k.g", "kgs.", "kg.", "kilogramme", "kilogrammes", "કિ.ગ્રા"],
    "g": ["gr.", "gr", "grs", "grm", "grms", "grm.", "gramme", "grammes", "gm.", "gms."],
    "quintal": ["quintal", "quintals", "qtl", "qtl.", "qtls", "ક્વિન્ટલ", "क्विंटल", "क्विन्टल"],
    "pav": ["pao", "pav", "paav", "પાવ", "पाव"],
    "liter": ["ltr", "ltrs", "ltr.", "lit", "lit.", "lts"],
    "ml": ["mltr", "mls", "m.l.", "m.l", "ml."],
    "piece": ["nos", "nos.", "no.s", "nag", "pcs.", "pc."],
    "pair": ["pair", "pairs", "prs", "pr", "jodi", "jodis", "જોડી", "जोड़ी"],
    "dozen": ["dzn", "dz", "darjan", "dozens", "दर्ज़न"],
    "rupee": ["rs", "rs.", "rupee", "rupees", "inr", "रुपये", "रुपए", "रुपया", "₹"],
    "packet": ["pkt", "pkts", "पैकेट्स"],
    "box": ["bx", "डिब्बे"],
    "bottle": ["btl"],
    "bag": ["બેગ", "बैग"],
}
AMOUNT_UNITS = spellings(ASCII_UNITS, GUJARATI_UNITS, HINDI_UNITS, MORE_UNITS)
