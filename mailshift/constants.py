"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the behaviour we
reproduce (label names, limits, property names, diagnostic texts and the target
capability table).  They are stated plainly, in their natural order, and kept
together here; no logic lives in this file.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Limits of the reference; operators take them as parameters, the verdict queries pass them.
MAX_LINE = 64 * 1024              # characters per header line
MAX_HEADERS = 256 * 1024          # characters per header block (each line + 2)
MAX_ARCHIVE = 512 * 1024 * 1024   # bytes per ZIP input
MAX_ENTRY = 128 * 1024 * 1024     # bytes per archive entry
MAX_EXPANDED = 256 * 1024 * 1024  # accepted bytes per archive
MAX_ENTRIES = 2000                # directory entries per archive
MAX_BATCH_EXPANDED = 512 * 1024 * 1024  # accepted bytes per selection
MAX_XML = 10 * 1048576            # bytes per filter XML
MAX_QUERY = 4096                  # UTF-16 units per search
MAX_TOKENS = 20                   # tokens per search
MAX_SIZE = 4294967295             # 32-bit byte limit for size tests

# Labels that mark a message as sent (compared lower-cased).
SENT = ["sent", "sent mail", "sent messages", "[gmail]/sent mail", "\\sent",
        "已发送", "已发送邮件", "已寄出", "已寄出的郵件", "寄件備份"]

# System labels (SENT plus these), never turned into folders.
SYSTEM_EXTRA = ["inbox", "all mail", "allmail", "draft", "drafts", "spam", "trash", "bin",
                "starred", "important", "unread", "read", "chats", "archived", "archive",
                "收件箱", "收件匣", "所有邮件", "所有郵件", "草稿", "垃圾邮件", "垃圾郵件",
                "垃圾箱", "垃圾桶", "已加星标", "已加星號", "重要", "未读", "未讀"]
SYSTEM = SENT + SYSTEM_EXTRA

# File names (last path segment) that mark a whole mbox file as sent mail.
SENT_FILE_PATTERN = r"(?i)^(sent|sent mail|已发送|已发送邮件|寄件備份|gesendet|envoyés)\.mbox\z"

# Mbox envelope and header line patterns (Java regex dialect; \z instead of $).
ENVELOPE = (r"^From \S+ (?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+"
            r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+"
            r"\d{2}:\d{2}(?::\d{2})?\s+(?:\S+\s+)?\d{4}(?:\s[^\n\r\u2028\u2029]*)?\z")
HEADER = r"^([!-9;-~]+):[ \t]*([^\n\r\u2028\u2029]*)\z"

# Filter-rule property names.
CRITERIA = ["from", "to", "subject", "hasTheWord", "doesNotHaveTheWord", "hasAttachment",
            "excludeChats", "size", "sizeOperator", "sizeUnit"]
ACTIONS = ["label", "forwardTo", "shouldArchive", "shouldMarkAsRead", "shouldStar", "shouldTrash",
           "shouldNeverSpam", "shouldAlwaysMarkAsImportant", "shouldNeverMarkAsImportant",
           "smartLabelToApply"]
SWITCHES = ["hasAttachment", "excludeChats", "shouldArchive", "shouldMarkAsRead", "shouldStar",
            "shouldTrash", "shouldNeverSpam", "shouldAlwaysMarkAsImportant",
            "shouldNeverMarkAsImportant"]
NEVER_CONVERTIBLE = ["hasAttachment", "excludeChats", "shouldNeverSpam",
                     "shouldAlwaysMarkAsImportant", "shouldNeverMarkAsImportant",
                     "smartLabelToApply"]
SIZE_UNITS = {"s_sb": 1, "s_skb": 1024, "s_smb": 1048576}
SIZE_OPERATORS = {"s_sl": ":over", "s_ss": ":under"}

# Search field names and operator words used in test descriptions.
FIELD_NAMES = {"from": "发件人", "to": "收件人", "cc": "抄送", "subject": "主题", "body": "正文",
               "header": "邮件头", "size": "大小", "attachment": "附件", "label": "标签",
               "is": "状态", "list": "邮件列表"}
OP_WORDS = {"is": "为", "contains": "包含", "over": "大于", "under": "小于"}
ATTACHMENT_WORD = "含附件"
DESCRIBE_JOIN = "，且"
BYTES_SUFFIX = " 字节"

# Mailbox diagnostics.
W_MALFORMED = "Some messages have malformed or missing headers; their labels and sender statistics were skipped."
W_UNTERMINATED_LABEL = "An unterminated quoted X-Gmail-Labels header was skipped."
W_SENT_NO_FROM = "Some sent messages have missing, multiple, or unsupported From addresses; these were not counted as sender identities."
W_NO_ENVELOPE = "Input contains a message without an mbox envelope; it was treated as a single RFC 822 message."
W_OUTSIDE = "Text outside an mbox message was ignored."
W_LIMITS = "Header limits exceeded (64 KiB per line, 256 KiB per message, measured as decoded characters); affected message statistics were skipped."
W_LOCAL_DUPES_SHARED = "文件内重复的 Message-ID 已从发件人计数中排除；邮件总数仍包含这些邮件，标签已合并。"
W_CROSS_DUPES = "已排除 {n} 封跨文件重复邮件的发件人计数；邮件总数与标签不受影响。"
W_REPLACEMENT = "解码后的邮件头中发现 {n} 个 Unicode 替换字符（可能存在无效 UTF-8）；请检查原始编码。"
W_INVALID_FROM = "发现 {n} 个无法保守解析的 From 值；未将其计入发件人身份。"

# Folder planning notes.
N_RESERVED = "与目标服务商的保留文件夹名称冲突；已跳过此标签。"
N_NORMALIZED = "Normalized Unicode, whitespace, or unsafe/empty path segments; review the target folder name."
N_NESTED = "Nested label preserved with /; confirm the target provider hierarchy delimiter."
N_LONG = "Long folder name; confirm the target provider length limit."
N_COLLISION = "Case-insensitive, normalized, or provider-reserved name collision; a numeric suffix was added."
N_RULE_MAPPING = "Rule destination needs an explicit user-folder mapping."

# Search rejection reasons (prefix "<raw>：" for per-token reasons).
Q_TOO_LONG = "查询长度超过 4096 个字符。"
Q_CONTROL = "查询含控制字符或换行分隔符。"
Q_EMPTY = "查询为空，不能生成无条件规则。"
Q_ESCAPE = "引号内只支持转义双引号或反斜杠。"
Q_UNCLOSED = "查询的双引号未闭合。"
Q_TOO_MANY = "查询超过 20 个词元（OR 也计数）。"
Q_OR = "不支持显式 OR：扁平测试 API 不表示析取，即使两个条件相同也必须跳过整条规则。"
Q_MINUS = "只支持一个前导减号，且必须有条件。"
Q_BRACES = "不支持大括号分组。"
Q_PARENS = "不支持括号分组或通配符 *、?。"
Q_QUOTE_SHAPE = "引号必须包围完整的单个值。"
Q_BARE_QUOTE = "裸值不支持引号拼接或反斜杠转义。"
Q_BLANK = "条件值为空。"
Q_COLON = "值含冒号或嵌套键，不能作为普通字面量。"
Q_NESTED = "值包含嵌套逻辑运算符。"
Q_ADDRESS = "邮箱必须是单个普通地址，不能是列表或显示名。"
Q_SIZE_SHAPE = "大小必须是非负整数，单位仅支持 K、M、G 或字节。"
Q_SIZE_RANGE = "大小超出 32 位字节范围。"
Q_HAS = "has: 仅支持 attachment。"
Q_KEY = "不支持 {key}: 运算符，必须跳过整条规则。"
Q_BOTH_POLARITIES = "同一条件同时肯定和否定，运算符冲突。"
Q_CONFLICT = "重复字段具有冲突的值或大小运算符。"
Q_SIZE_CONFLICT = "大小上限与下限冲突。"

# Namespaces of filter feeds, and the diagnostics of their properties.
ATOM_NAMESPACE = "http://www.w3.org/2005/Atom"
APPS_NAMESPACE = "http://schemas.google.com/apps/2006"
R_XML_PROPERTY = "Invalid or duplicate property: {name}"
R_XML_UNSUPPORTED = "Unsupported XML property: {name}"
UNNAMED = "(unnamed)"

# Rule-conversion diagnostics.
R_RECIPE = "This target requires manual rules; no Sieve can be emitted."
R_UNKNOWN_TARGET = "Unknown destination uses the generic capability baseline only; confirm server support before enabling."
R_UNSAFE_ID = "Unsafe control character in rule ID."
R_UNSUPPORTED_FIELD = "Unsupported field: {name}"
R_UNSAFE_VALUE = "Unsafe control character in {name}."
R_BAD_BOOLEAN = "Invalid boolean for {name}."
R_NEVER = "Unsupported {name}; the entire rule was skipped."
R_EXACT_ADDRESS = "{name} must contain one exact email address, not Gmail search syntax."
R_SUBJECT_SYNTAX = "Subject must be plain literal text without search operators."
R_SUBJECT_WARN = "Subject uses a literal substring test; Gmail word matching may differ. Review before enabling."
R_QUERY_SUBJECT_WARN = "Query subject uses a literal substring test; Gmail word matching may differ. Review before enabling."
R_QUERY_CONDITION = "Unsupported query condition {raw}; the entire rule was skipped."
R_SIZE = "Size needs an integer, known Gmail unit/operator, and a 32-bit byte count."
R_NO_CONDITION = "No supported condition; unconditional rules are not emitted."
R_AMBIGUOUS_TRASH = "Trash combined with label/archive has ambiguous delivery semantics."
R_FLAGS_WARN = "Per-rule flags may not preserve Gmail accumulated flag behavior across matching rules."
R_BAD_FOLDER = "Invalid or unsafe destination folder for {name}."
R_COLLISION = "Destination folder collision for {name}; the entire rule was skipped."
R_TRASH_WARN = "Trash is mapped to a Trash folder, not permanent deletion; confirm the destination folder."
R_LABEL_WARN = "Gmail labels are not independent message copies; fileinto plus keep approximates labeling and may create separate copies."
R_ARCHIVE_WARN = "Archive removes Inbox delivery by filing into the mapped label or Archive folder; verify provider folder semantics."
R_FORWARD = "Forwarding requires one exact email address."
R_NO_ACTION = "No supported action."
R_MULTIPLE = "Multiple rules may match: Gmail accumulated delivery/flag semantics differ from Sieve keep/fileinto and per-delivery flags. Manual review required."
R_DISABLED = "Approximate rule disabled by default; review before explicitly enabling."
SCRIPT_HEADER = "# Gmail filter conversion. Review the report and create destination folders before enabling.\n"

# Capability-check messages.
C_EXT_OK = "扩展 {ext}：在候选能力列表中，仍需实际验证"
C_EXT_BAD = "扩展 {ext}：不支持或尚未确认，不能生成依赖它的规则"
C_ACT_OK = "动作 {act}：候选支持，仍需验证实际语义"
C_ACT_BAD = "动作 {act}：不支持或尚未确认{need}，请手工核对，不可静默忽略"
C_ACT_NEED = "（需要 {ext} 能力）"
C_LIMIT = "账户活动过滤器数量 {n} 超过保守上限 {max}；这不等同于单个脚本中的条件块数量，请确认套餐限制。"
ACTION_EXTENSIONS = {"fileinto": "fileinto", "addflag": "imap4flags", "setflag": "imap4flags",
                     "removeflag": "imap4flags", "set": "variables"}
CORE_ACTIONS = ["keep", "discard", "stop"]

# Target providers, in their fixed order.
TARGETS = [
    dict(id="generic", label="通用 Sieve", kind="sieve", verifyStatus="unverified",
         extensions=["fileinto"], supportsFlags=False, supportsRedirect=True, supportsVariables=False,
         maxActiveRules=None, folderDelimiter="/", archiveFolder="Archive", trashFolder="Trash",
         reserved=["Inbox", "Archive", "Trash", "Sent", "Drafts", "Junk"],
         notes=["仅以 RFC 5228 核心命令与 fileinto 子集为基线；未连接真实服务器验证。",
                "服务器必须实际提供 fileinto；Archive/Trash 只是约定名称，请核对文件夹、分隔符与扩展能力。",
                "未列出的扩展按不支持处理；规则上限未知不等于无限。"],
         docsUrl="https://www.rfc-editor.org/rfc/rfc5228"),
    dict(id="fastmail", label="Fastmail", kind="sieve", verifyStatus="unverified",
         extensions=["fileinto", "imap4flags", "copy", "body", "variables"],
         supportsFlags=True, supportsRedirect=True, supportsVariables=True,
         maxActiveRules=None, folderDelimiter="/", archiveFolder="Archive", trashFolder="Trash",
         reserved=["Inbox", "Archive", "Trash", "Sent", "Drafts", "Junk"],
         notes=["能力列表是文档层面的候选能力，未在真实 Fastmail 账户测试，不保证导入成功。",
                "请在 Sieve 编辑器检查脚本，并核对实际文件夹路径、账户套餐及转发限制；规则上限未知。"],
         docsUrl="https://www.fastmail.help/hc/en-us/articles/1500000280481-Using-Sieve-scripts-in-Fastmail"),
    dict(id="proton", label="Proton Mail", kind="sieve", verifyStatus="unverified",
         extensions=["fileinto", "imap4flags", "body", "variables"],
         supportsFlags=True, supportsRedirect=False, supportsVariables=True,
         maxActiveRules=1, folderDelimiter="/", archiveFolder="Archive", trashFolder="Trash",
         reserved=["Inbox", "Archive", "Trash", "Sent", "Drafts", "Spam", "All Mail"],
         notes=["未在真实 Proton Mail 账户测试；Sieve 编辑及可用功能需核对付费套餐。",
                "免费套餐仅允许 1 个活动过滤器；本配置保守采用此上限，付费套餐请按账户实际限制确认。Sieve 脚本中的条件块不一定等于账户活动过滤器数量。",
                "不声明支持 Sieve redirect 或 copy；账户转发功能不能当作 redirect 兼容性证明。",
                "请预先创建目标文件夹或标签；系统文件夹与自定义文件夹路径须在编辑器确认。"],
         docsUrl="https://proton.me/support/sieve-advanced-custom-filters"),
    dict(id="outlook", label="Outlook.com", kind="recipe", verifyStatus="manual",
         extensions=[], supportsFlags=False, supportsRedirect=False, supportsVariables=False,
         maxActiveRules=None, folderDelimiter="/", archiveFolder="Archive", trashFolder="Deleted Items",
         reserved=["Inbox", "Archive", "Deleted Items", "Sent Items", "Drafts", "Junk Email"],
         notes=["Outlook.com 网页版没有本工具所需的 Sieve 规则文件导入；桌面 Outlook 的规则导入不是同一功能。",
                "请在设置 → 邮件 → 规则中逐条创建；条件、动作、顺序及停止处理行为需手动核对，未做真实账户测试。",
                "系统文件夹名称会随界面语言变化；请选取账户中的实际文件夹。规则上限未知。"],
         docsUrl="https://support.microsoft.com/outlook"),
    dict(id="yahoo", label="Yahoo Mail", kind="recipe", verifyStatus="manual",
         extensions=[], supportsFlags=False, supportsRedirect=False, supportsVariables=False,
         maxActiveRules=None, folderDelimiter="/", archiveFolder="Archive", trashFolder="Trash",
         reserved=["Inbox", "Archive", "Trash", "Sent", "Drafts", "Spam"],
         notes=["Yahoo Mail 没有本工具所需的 Sieve 规则文件导入；必须在设置 → 更多设置 → 过滤器中手工重建。",
                "普通过滤器主要用于按条件移动邮件；不要假定支持 Gmail 的星标、标签、已读或逐规则转发语义。未做真实账户测试。",
                "过滤器顺序、实际文件夹名称及账户限制须自行核对；规则上限未知。"],
         docsUrl="https://help.yahoo.com/kb/mail"),
    dict(id="unknown", label="尚未确定", kind="sieve", verifyStatus="unverified",
         extensions=["fileinto"], supportsFlags=False, supportsRedirect=True, supportsVariables=False,
         maxActiveRules=None, folderDelimiter="/", archiveFolder="Archive", trashFolder="Trash",
         reserved=["Inbox", "Archive", "Trash", "Sent", "Drafts", "Junk"],
         notes=["目标尚未确定，仅暂用通用 RFC 5228 与 fileinto 子集；这不是兼容性承诺。",
                "导入前必须确认服务商支持 Sieve、fileinto、实际文件夹名称及规则限制；未做真实服务器测试。"],
         docsUrl=None),
]

# Report texts.
CSV_HEADER = "﻿地址,邮件数量,置信度,来源"
REDACTED = "[邮箱已省略]"
RECIPE_RULE = "## 规则 "
RECIPE_ORIGINAL = "### 原始 Gmail 规则"
RECIPE_STEPS = [
    "### 目标动作",
    "按上方原始说明中 → 右侧的动作逐项核对；这是待人工映射的动作，不表示目标服务商已支持。",
    "",
    "### 手工步骤",
    "1. 打开目标邮箱的规则或过滤器设置，新建规则，并对照原始 Gmail 条件逐项填写；无法表达的条件不要删掉后继续。",
    "2. 按动作对照选择实际存在的目标文件夹和可用动作；不支持的动作记录为待处理，不启用不完整规则。",
    "3. 核对多条件的“且/或”、规则顺序、是否停止后续处理、归档与保留收件箱行为。",
    "4. 保存前用匹配和不匹配的测试邮件验证；确认后才启用，并保留原始 Gmail 规则作为回退依据。",
    "",
    "### 注意事项",
]
RECIPE_STATUS = "- 转换状态："
RECIPE_NO_ISSUE = "- 无转换诊断不代表目标兼容，仍须人工测试。"
RECIPE_LAST = "- skipped 或 approximate 规则必须逐项解决问题；无法迁移时明确记录，绝不静默丢弃。"
# ------------------------------------------------------------ END FIXED VALUES
