"""Values the SQL texts compare against, written out apart from the library.

A wrong constant in the library then fails a comparison instead of being wrong on both sides.
"""

# Delivery reasons and headings.
NO_SOURCES = "未配置新闻源"
NO_ITEMS = "未配置金融数据项"
NO_RECIPIENTS = "未配置收件人"
NO_SMTP = "未配置 SMTP"
NO_NEWS = "无新增文章（所有文章已在历史记录中）"
NO_QUOTES = "无金融行情数据"
STOCK_HEADING = "行业龙头股价"
FUTURES_HEADING = "大宗商品行情"

# Health messages and labels.
TIMED_OUT = "请求超时（>10.0s）"
NO_LINKS = "页面正常但未找到链接（选择器: %s）"
LABELS = {"healthy": "✓ 正常", "warning": "⚠ 警告", "error": "✗ 异常", "unknown": "? 未知"}

# Elements, lengths and phrases that page texts leave out.
SUMMARY_NOISE = ("script", "style", "nav", "footer", "aside")
ARTICLE_NOISE = (*SUMMARY_NOISE, "header", "iframe", "form", "button", "noscript")
SUMMARY_MIN_PARAGRAPH = 10
ARTICLE_MIN_PARAGRAPH = 15
SUMMARY_PHRASES = (
    "版权所有", "转载请注明", "相关阅读", "点击进入", "网站地图", "关于我们",
    "English", "联系我们", "免责声明", "隐私政策", "订阅", "分享到",
)
ARTICLE_PHRASES = (
    *SUMMARY_PHRASES, "责任编辑", "来源：", "编辑：", "审核：", "更多精彩", "扫一扫", "关注公众号", "下载APP",
)

# Prefixes that answers lose, and the mark of a cut text.
TITLE_PREFIXES = (
    "News", "news", "新闻", "标题：", "标题:", "Coal", "Electricity", "Natural Gas", "Oil",
    "Renewables", "Bioenergy", "Nuclear", "Hydrogen", "Energy Efficiency",
)
SUMMARY_PREFIXES = ("摘要：", "摘要:", "本文", "文章", "新闻")
OMITTED = "\n\n[中间部分省略]\n\n"
PROMPTS = {
    "en": "把下面的英文标题译成中文，并用不超过 {n} 个汉字概括正文。只输出一行：中文标题|中文摘要\n\n标题：\n%s\n\n正文：\n%s",
    "zh": "用不超过 {n} 个汉字概括下面的新闻，只输出摘要。\n\n标题：\n%s\n\n正文：\n%s",
}

# What is masked, and by what.
_WORD = r"[\p{L}\p{N}_"
MASKS = (
    (_WORD + r".+-]+@" + _WORD + r"-]+\." + _WORD + r".]+", "***@***.***"),
    (r"""(?i)(password['\"]?\s*[:=]\s*)['\"]?""" + _WORD + r"""!@#$%^&*]+['\"]?""", "$1***"),
    (r"(?i)(Authorization:\s*" + _WORD + r"]+\s+)" + _WORD + r".=+/-]+", "$1***"),
    (r"""(?i)(api[_-]?key['\"]?\s*[:=]\s*)['\"]?""" + _WORD + r"""\-]+['\"]?""", "$1***"),
    (r"""(?i)(token['\"]?\s*[:=]\s*)['\"]?""" + _WORD + r"""\-]+['\"]?""", "$1***"),
    (r"""(?i)(secret['\"]?\s*[:=]\s*)['\"]?""" + _WORD + r"""\-]+['\"]?""", "$1***"),
    (r"(?i)(Bearer\s+)" + _WORD + r"\-.=+/]+", "$1***"),
    (r"gAAAAA" + _WORD + r"\-=+/]{20,}", "gAAAAA***"),
)
