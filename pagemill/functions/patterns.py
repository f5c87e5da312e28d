"""Patterns shared by the column functions and the SQL they are compared with (fixed values).

All are written for both Java and RE2: explicit classes, no look-around.
"""

#: White space as the text sources count it: with the no-break and the wide blanks.
WS = r"[\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_WS = WS.replace("[", "[^", 1)
TRIM = rf"^{WS}+|{WS}+$"
NOT_WORD = r"[^\p{L}\p{N}]+"

_FIGURE_KIND = (
    rf"extended{WS}+data{WS}+fig(?:ure)?|supplementary{WS}+fig(?:ure)?|supporting(?:{WS}+information)?{WS}+fig(?:ure)?|fig(?:ure)?|图"
)
_FIGURE_NUMBER = r"[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*"
#: Kind and number of a figure at the start of a text.
FIGURE_KEY = rf"(?i)^{WS}*({_FIGURE_KIND})\.?{WS}*({_FIGURE_NUMBER})"
DELIMITER = r"[|｜:：.]"
#: What stands behind a figure's number if it is a caption's title.
#: Fixed value: it decides which captions are formal and so the anchors of figure groups.
FORMAL_TITLE = rf"^(?:{WS}*{DELIMITER}{WS}*|{WS}+)([^|｜:：.\x{{09}}-\x{{0D}}\x{{20}}\x{{A0}}\x{{3000}}][\s\S]*)$"
REFERENCE_VERB = (
    r"(?i)^(?:shows?|illustrates?|depicts?|demonstrates?|presents?|reports?|displays?|compares?|lists?|summari[sz]es?"
    r"|gives?|provides?|plots?|is|are|was|were)\b"
)
_NEXT_PAGE = (
    rf"(?:see{WS}+(?:the{WS}+)?next{WS}+page{WS}+for{WS}+(?:the{WS}+)?caption|caption{WS}+(?:is{WS}+)?continued{WS}+on{WS}+(?:the{WS}+)?next{WS}+page"
    rf"|continued{WS}+on{WS}+(?:the{WS}+)?next{WS}+page|caption{WS}+(?:is{WS}+)?(?:on|over){WS}+(?:the{WS}+)?next{WS}+page|continued{WS}+overleaf"
    r"|图注(?:见|续见|续|在)?(?:下一|下)页|(?:下一|下)页(?:续见|续|见)图注)"
)
#: A text that is only the mark of a caption on the next page.
NEXT_PAGE_ONLY = rf"(?i)^{WS}*(?:{_FIGURE_KIND})\.?{WS}*{_FIGURE_NUMBER}{WS}*{DELIMITER}{WS}*{_NEXT_PAGE}[.!?。！？]?{WS}*$"
#: The mark anywhere in a text.
NEXT_PAGE_INSIDE = rf"(?i)(?:^|[^A-Za-z0-9_])(?:{_FIGURE_KIND})\.?{WS}*{_FIGURE_NUMBER}{WS}*{DELIMITER}{WS}*{_NEXT_PAGE}"
PANEL_LABEL = rf"^{WS}*[\[(]?[A-Za-z][\])\].:]?{WS}*$"
PANEL_START = rf"^{WS}*[\[(]?[A-Za-z][\])\].:]?(?:{WS}|[,;:])"
CLOSING_TAGS = rf"(?:</[^>]+>{WS}*)+$"
TERMINAL = r"[.!?。！？][\"'”’)\]}]*$"

OPAQUE_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"
SHA256 = r"^[0-9a-f]{64}$"
BLOCK_ID = r"^blk_[0-9a-f]{24}$"
SLOT_ID = r"^slot_[0-9a-f]{24}$"
ASSET_ID = r"^ast_[0-9a-f]{24}$"
HEX16 = r"^[0-9a-f]{16}$"
BLOCK_MARK = r'^<!-- p2md:block id="(blk_[0-9a-f]{24})" kind="([a-z_]+)" -->$'
SLOT_MARK = r'^<!-- p2md:slot id="(slot_[0-9a-f]{24})" asset="(ast_[0-9a-f]{24})" -->$'

PMID = r"(?i)^(?:pmid\s*:\s*)?(\d{1,9})$"
PMCID = r"(?i)^(?:pmcid\s*:\s*)?(PMC\d+)$"
DOI = r"(?i)^(?:doi\s*:\s*)?(10\.\d{4,9}/\S+)$"
ID_PREFIX = r"(?i)^(?:pmid|pmcid|doi)\s*:"
URL = r"(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"

#: Segments of a package path that are not allowed.
BAD_SEGMENT = (
    r"[\x{00}-\x{1F}<>:\"|?*#]|[. ]$|(?i)^(?:con|prn|aux|nul|clock\$|conin\$|conout\$|com[1-9]|lpt[1-9])(?:\..*)?$"
    r"|^(?:__proto__|constructor|prototype)$"
)
#: Which lines are headings decides the heading ids and sections of a text; which marks are images decides their numbers.
ATX = r"^ {0,3}(#{1,6})[\t ]+(.+?)[\t ]*#*[\t ]*$"
FENCE = r"^ {0,3}(`{3,}|~{3,})"
SETEXT = r"^ {0,3}(?:=+|-+)\s*$"
LIST_ITEM = r"^(?:[-*_]>?|\d+[.)])\s"
IMAGE = r"!\[[^\]]*\]\(\s*(?:<([^>]+)>|([^\s)]+))(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)"

VISUAL_TYPES = ("image", "chart")
TABLE_TYPES = ("table", "table_body")
EQUATION_TYPES = ("equation", "interline_equation")
MARGINAL_TYPES = ("aside_text", "footer", "header", "page_footer", "page_footnote", "page_header", "page_number")
TITLE_TYPES = ("title", "paragraph_title")
TEXT_TYPES = ("text", "paragraph", "ref_text", "list")
