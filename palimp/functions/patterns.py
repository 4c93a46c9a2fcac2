"""Regular expressions on HTML and text.

They use only syntax that Java and RE2 read the same way: explicit classes, no look-around.
"""

_VALUE = r"""[ \t]*=[ \t]*(?:"([^"]*)"|'([^']*)'|([^ \t\r\n"'<>=`]+))"""


def attribute(names: str) -> str:
    """Groups: 1 = attribute name, 2, 3 or 4 = value."""
    return rf"(?i)[ \t\r\n]({names}){_VALUE}"


SCRIPT = r"(?is)<script([^>]*)>(.*?)</script[^>]*>"
STYLE = r"(?is)<style[^>]*>.*?</style[^>]*>"
COMMENT = r"(?s)<!--(.*?)-->"
TAG = r"<[^>]*>"
SPACES = r"[ \t\r\n\f\x0B]+"
NOT_SPACE = r"[^ \t\r\n\f\x0B]"
TITLE = r"(?is)<title[^>]*>(.*?)</title[^>]*>"
HTML_TAG = r"(?i)<html[^>]*>"
META = r"(?i)<meta[^>]*>"
HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
INPUT = r"(?i)<input[^>]*>"
TEXTAREA = r"(?is)<textarea([^>]*)>(.*?)</textarea>"
FIELD = r"(?i)<(?:input|select|textarea)[ \t\r\n/>]"
ANCHOR = r"(?i)<a[ \t\r\n][^>]*>"
FORM = r"(?i)<form[^>]*>"
IFRAME = r"(?i)<iframe[^>]*>"
EMBED = r"(?i)<embed[^>]*>"
OBJECT = r"(?i)<object[^>]*>"
DATA_URI = r"""(?i)["'](data:[^"']*)["']"""
HANDLER = attribute("on[a-z]+")
META_REFRESH = r"""(?i)<meta[^>]*http-equiv[ \t]*=[ \t]*["']?refresh[^>]*>"""
HIDDEN_BLOCK = r"(?i)<template[ \t\r\n>]|<[a-z0-9]+[^>]*[ \t\r\n]hidden[ \t\r\n=>/]"
HIDDEN_STYLE = (r"""(?i)[;"'{ \t\r\n](?:display[ \t]*:[ \t]*none|visibility[ \t]*:[ \t]*hidden"""
                r"""|font-size[ \t]*:[ \t]*0(?:px|pt|em|rem|%)?)[;"'} \t\r\n]""")
LD_JSON = r"(?i)application/ld\+json"
JAVASCRIPT_URL = r"(?i)^[ \t\r\n]*javascript:"
LAUNCH_URL = r"(?i)^file:|[.](?:exe|bat|cmd|msi|scr|ps1|vbs|jar)(?:[?#].*)?$"
REFRESH = r"""(?i)http-equiv[ \t]*=[ \t]*["']?refresh"""
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
