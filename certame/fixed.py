"""Fixed values of the exam-bank domain."""

from __future__ import annotations

# The four subject areas, in print order.
AREAS = (
    "Linguagens, Codigos e suas Tecnologias",
    "Ciencias Humanas e suas Tecnologias",
    "Ciencias da Natureza e suas Tecnologias",
    "Matematica e suas Tecnologias",
)
LINGUAGENS, HUMANAS, NATUREZA, MATEMATICA = AREAS
# Names of areas in texts, in the order in which they are looked for.
AREA_NAMES = (
    ("linguagens", LINGUAGENS),
    ("linguagens, códigos e suas tecnologias", LINGUAGENS),
    ("linguagens, codigos e suas tecnologias", LINGUAGENS),
    ("ciências humanas e suas tecnologias", HUMANAS),
    ("ciencias humanas e suas tecnologias", HUMANAS),
    ("humanas", HUMANAS),
    ("ciências da natureza e suas tecnologias", NATUREZA),
    ("ciencias da natureza e suas tecnologias", NATUREZA),
    ("natureza", NATUREZA),
    ("matemática e suas tecnologias", MATEMATICA),
    ("matematica e suas tecnologias", MATEMATICA),
    ("matemática", MATEMATICA),
    ("matematica", MATEMATICA),
)
LETTERS = ("A", "B", "C", "D", "E")
# Names of mock-exam vendors in folder names.
VENDORS = (("bernoulli", "BERNOULLI"), ("farias brito", "FARIAS_BRITO"), ("poliedro", "POLIEDRO"), ("sas", "SAS"), ("somos", "SOMOS"))
# Filters that each source knows, beside area and tipo.
SOURCE_FILTERS = {"ENEM": ("ano", "dia", "competencia", "provedor"), "EXATO": ("evento", "turno"), "UFT": ("ano", "turno", "evento")}
DEFAULT_SOURCE = "ENEM"
EVENTS = ("CICLO_ZERO", "1_SIMULADO_TESSAT", "2_SIMULADO_TESSAT", "OUTUBRO_2025", "ABRIL_2026", "NATUREZAS_TESSAT", "TRADICIONAIS")
# Labels.
EVENT_LABELS = {
    "CICLO_ZERO": "Ciclo Zero",
    "1_SIMULADO_TESSAT": "1º Simulado",
    "2_SIMULADO_TESSAT": "2º Simulado",
    "OUTUBRO_2025": "Outubro 2025",
    "ABRIL_2026": "Abril 2026",
    "NATUREZAS_TESSAT": "Naturezas",
    "TRADICIONAIS": "Tradicionais",
    "1_EDICAO": "1ª Edição",
    "2_EDICAO": "2ª Edição",
} | {f"SIM_{n:02d}": f"Sim. {n:02d}" for n in range(9)}
DAY_LABELS = {"dia1": "1º Dia", "dia2": "2º Dia", "simu_dia1": "1º Dia", "simu_dia2": "2º Dia"}
VENDOR_LABELS = {"BERNOULLI": "Bernoulli", "SAS": "SAS", "POLIEDRO": "Poliedro", "FARIAS_BRITO": "Farias Brito", "SOMOS": "Somos"}
# Voided questions of the national exam, year and number.
VOIDED = ((2018, 150), (2020, 114), (2020, 141), (2021, 178), (2022, 175), (2023, 177), (2024, 129))
# Raised and lowered characters.
RAISED = (
    "0123456789+-=()abcdefghijklmnoprstuvwxyz",
    "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ",
)
LOWERED = (
    "0123456789+-=()aehijklmnoprstuvx",
    "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ",
)
# Layout of a scanned answer sheet (A4 at 96 DPI), and of decisions on its bubbles.
SHEET_WIDTH, SHEET_HEIGHT = 794, 1123
SHEET_MARGIN, SHEET_HEADER, SHEET_FOOTER = 28 / 595, 0.20, 50
PER_ROW, BUBBLE, BUBBLE_GAP, BUBBLE_RADIUS = 5, 14, 3, 7
FILLED, CLEAR_LEAD, DOUBTFUL = 0.35, 0.10, 0.5
# Markers of an answer sheet's corners.
MARKER_SIDES, MARKER_ASPECT = (0.004, 0.08), (0.5, 2.0)
# Fixed value: how far, as a share of its length, a marker's outline may lie from its simplified one.
MARKER_SLACK = 0.06
THRESHOLD_BLOCK, THRESHOLD_OFFSET, BLUR = 21, 8, 7
# Marks, colours, and limits.
MEDALS = ((90, "ouro"), (70, "prata"), (50, "bronze"))
PAGE_SIZE, MINUTES_PER_QUESTION, DEFAULT_SAMPLE = 12, 3, 10
LOADED_CONFIDENCE = 0.80
