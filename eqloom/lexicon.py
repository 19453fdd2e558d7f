"""Word lists, patterns and symbol tables that results depend on."""

# Words and artifact tokens left out of the retrieval index.
RETRIEVAL_STOP = "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might can this that these those it its we our us as if when where which who what how".split()
RETRIEVAL_ARTIFACTS = "italic start end over road superscript subscript postsubscript postsuperscript".split()

# Stop words of the pairwise TF-IDF.
PAIR_STOP = "the a an and or in on at to for of with by from is are was be been this that it we as if not no".split()

# Stop words of the query that looks for a formula's meaning.
MEANING_STOP = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might can "
    "this that these those it its we our us as if when where which who whom what how not no also both each all any such given here thus hence "
    "equation eq fig figure table section note above below following shown see italic start end postsubscript postsuperscript arg over displaystyle rm bf operatorname"
).split()

# Names of well-known equations and objects.
GAZETTEER = [
    "Schrödinger equation", "Schrodinger equation", "Hamiltonian", "Lindblad equation", "Lindblad master equation", "master equation", "von Neumann equation",
    "Fokker-Planck equation", "Bloch equation", "Maxwell equation", "Maxwell's equation", "Dirac equation", "Heisenberg equation", "Liouville equation",
    "Liouville-von Neumann equation", "density matrix", "density operator", "partition function", "Green's function", "Green function", "Wigner function",
    "Husimi function", "Jaynes-Cummings", "Rabi model", "tight-binding", "Bogoliubov",
]

# Cues of a derivation.
DERIVATION_CUES = ["substituting", "inserting", "derived from", "follows from", "combining", "plugging", "yields", "into eq", "using eq"]

# LaTeX commands and letters that name no symbol.
SKIP_COMMANDS = (
    "begin end frac dfrac tfrac cfrac sqrt root over atop left right bigl bigr Bigl Bigr biggl biggr Biggl Biggr big Big "
    "hat bar tilde vec dot ddot dddot breve acute grave check widehat widetilde overline underline overbrace underbrace overleftarrow overrightarrow overleftrightarrow "
    "text rm mathrm mathbf mathit mathcal mathbb mathfrak mathsf mathtt boldsymbol bm emph bf it tt sf "
    "quad qquad hspace vspace hfill vfill displaystyle textstyle scriptstyle scriptscriptstyle limits nolimits mspace mkern "
    "cdot cdots ldots vdots ddots times div pm mp otimes oplus ominus oslash odot wedge vee leq geq neq approx equiv sim simeq propto ll gg subset supset subseteq supseteq "
    "in notin ni cup cap setminus rightarrow leftarrow Rightarrow Leftarrow leftrightarrow Leftrightarrow to gets langle rangle vert Vert dagger ddagger circ bullet star "
    "partial nabla infty emptyset forall exists int oint iint iiint sum prod coprod exp log ln lg sin cos tan cot sec csc arcsin arccos arctan arccot sinh cosh tanh "
    "max min sup inf lim limsup liminf det tr Tr ker dim deg gcd lcm mod arg Re Im label ref eqref nonumber notag tag not ne le ge leavevmode nobreak strut hbox"
).split()
SKIP_LETTERS = list("dnijklm")

# Greek letters by name, with their characters.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ",
    "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ",
    "tau": "τ", "upsilon": "υ", "phi": "φϕ", "chi": "χ", "psi": "ψ", "omega": "ω", "Gamma": "Γ", "Delta": "Δ",
    "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ",
    "Omega": "Ω", "hbar": "ℏħ",
}

# Symbol queries know one more command, and don't know three letters.
QUERY_FORMS = {"\\varepsilon": ["epsilon", "varepsilon", "ε"]}
NO_QUERY_FORMS = ["Xi", "Upsilon", "hbar"]

# LaTeX of MathML identifiers beside the first Greek forms, of operators, and of accents.
IDENTIFIERS = {"ħ": "\\hbar", "∞": "\\infty"}
OPERATORS = {
    "∂": "\\partial", "∇": "\\nabla", "∞": "\\infty", "∫": "\\int", "∮": "\\oint", "∑": "\\sum", "∏": "\\prod",
    "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "≈": "\\approx", "∈": "\\in", "∉": "\\notin", "⊂": "\\subset", "⊃": "\\supset",
    "∪": "\\cup", "∩": "\\cap", "∧": "\\wedge", "∨": "\\vee", "→": "\\rightarrow", "←": "\\leftarrow", "↔": "\\leftrightarrow",
    "⟨": "\\langle", "⟩": "\\rangle", "†": "\\dagger", "‡": "\\ddagger", "×": "\\times", "÷": "\\div", "±": "\\pm", "∓": "\\mp",
    "·": "\\cdot", "⋅": "\\cdot", "∝": "\\propto", "∼": "\\sim", "≃": "\\simeq", "≡": "\\equiv", "⊗": "\\otimes", "⊕": "\\oplus", "‖": "\\|",
    "\u2061": "", "\u2062": "", "\u2063": "",
}
ACCENTS = {
    "^": "\\hat", "ˆ": "\\hat", "¯": "\\bar", "‾": "\\bar", "˙": "\\dot", "˜": "\\tilde", "~": "\\tilde",
    "\u20d7": "\\vec", "→": "\\vec", "\u0308": "\\ddot",
}

# Phrases that define a symbol, with their confidence; {SYM} stands for its forms.
DEFINITIONS = [
    ("where_is", r"\bwhere\s+{SYM}\s+(?:is|are|denotes?|represents?|gives?|stands?\s+for|corresponds?\s+to)\s+(?:the\s+)?(.+?)(?:[,;]|\s+and\s+|\.$|$)", "high"),
    ("let_be", r"\blet\s+{SYM}\s+be\s+(?:the\s+)?(.+?)(?:[,;.]|$)", "high"),
    ("sym_is", r"\b{SYM}\s+(?:is|are|denotes?|represents?|corresponds?\s+to)\s+(?:the\s+)?(.+?)(?:[,;.]|$)", "high"),
    ("the_noun_sym", r"\bthe\s+((?:\w+\s+){0,4}\w+)\s+{SYM}(?:\b|$)", "medium"),
    ("sym_the", r"\b{SYM}\s*,\s+the\s+([\w\s\-]+?)(?:[,;.]|$)", "low"),
]

# Words that reject a definition.
DANGLING = "the a an of in for to is are and or with by from at on its their where into that as which each given such than but only between within".split()
DEFINITION_STOP = "the a an and or but in on at to for of with by from is are was were be been this that it we as if not no also".split()

# Patterns, in the dialect that Java and RE2 share.
ARTIFACTS = r"\bitalic_\w+|\bstart_[A-Z]\w*|\bend_[A-Z]\w*|\bover[a-z]*_ARG\b|\broad_[A-Za-z_]+|\b(?:superscript|subscript|POSTSUBSCRIPT|POSTSUPERSCRIPT)\b"
CONTEXT_ARTIFACTS = r"\bitalic[-_]\S+|\bstart_[A-Z]\w*|\bend_[A-Z]\w*|\bover[a-z]*_ARG\b|\broad_[A-Za-z_]+|\bcaligraphic_\S+|\bbold_[a-z]\S*"
MATH_LETTERS = r"[\x{1D400}-\x{1D7FF}\x{2061}-\x{2064}]"
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{AD}]"
SCRIPTS = r"[_^]\{[^{}]*\}"
RAW_LATEX = r"\\[a-zA-Z]+(?:\{[^{}]*\})*"
SCRIPT_WORDS = r"(?i)\b(?:subscript|superscript|postsubscript|postsuperscript)\b"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z(])"
CITATION = r"(?i)(?:eq(?:uation)?s?\.?\s*)?\(\s*(\d+[a-z]?(?:\.\d+)?)\s*\)"
DEFINITION_CUE = r"(?i)\b(?:define[sd]?|describes?|represents?|gives?|denotes?|is\s+defined\s+(?:as|by))\b"
EQ_NUMBER = r"^\s*\(\s*([\dA-Za-z]+(?:[.\-][\dA-Za-z]+)*)\s*\)\s*$"
BRACKETED = r"\(\s*([0-9A-Za-z]+(?:[.\-][0-9A-Za-z]+)*)\s*\)"
PDF_FORMULA = r"^(.*?)\s{2,}\(\s*([\dA-Za-z]+(?:[.\-][\dA-Za-z]+)*)\s*\)\s*$"
CITED_BEFORE, CITED_AFTER = r"(?:eq(?:uation)?s?\.?\s*)?\(\s*", r"\s*\)"
LINK_TARGET, LINK_NUMBER = r"\.[Ee](?:Gx)?\d+", r"(\d+[a-z]?(?:\.\d+)?)"
PARAGRAPH, SECTION_OF = r"^(.+\.)p(\d+)$", r"^(.+?)\.p\d+$"
ANY_CITATION = r"[Ee]quations?\s*\(\s*[\dA-Za-z]+(?:[.\-][\dA-Za-z]+)*\s*\)|[Ee]qs?\.?\s*\(\s*[\dA-Za-z]+(?:[.\-][\dA-Za-z]+)*\s*\)|(?<!\()\(\s*[\dA-Za-z]+(?:[.\-][\dA-Za-z]+)*\s*\)(?!\s*\))"
INLINE_MATH = r"\$[^$]+\$|\\\([^)]+\\\)|\\[a-zA-Z]+\{[^}]*\}"
GARBAGE = r"^[a-zA-Z]$|^[\\^_{}()\[\]|]+$|^\\.+"
NOISE = r"\bitalic[-_]\S+|\bstart_[A-Z]\w*|\bend_[A-Z]\w*|\broad_[A-Za-z_]+|\bcaligraphic_\S+|\bbold_[a-z]\S*|[\x{1D400}-\x{1D7FF}]|[_^]\{[^{}]*\}|\\[a-zA-Z]+(?:\{[^{}]*\})*|\b(?:subscript|superscript|postsubscript|postsuperscript)\b|\x{A0}"
