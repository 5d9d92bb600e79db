"""Fixed values that must equal the source application's for right results.

Everything in this module is a literal the original export format or the
original cleaning rules fix: column-role keywords (matched lower-cased, as a
substring of the column name), status texts, and the labels of the two
match-fallback states.  They are kept here, in their natural order, so the
rest of the library refers to them by name.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: column-role keywords (lower-cased "contains" test, in order)
# ---------------------------------------------------------------------------
KW_PROFILE_SKU = ("商品编号", "sku", "编号", "货号", "商品id")
KW_ORDER_SKU = ("商品编号", "sku", "编号", "货号")
KW_ORDER_AMOUNT_PROFILE = ("买家实付", "实付", "金额", "价格", "付款")
KW_ORDER_STATUS_PROFILE = ("状态", "订单状态", "status")
KW_SHOP_PROFILE = ("店铺", "shop", "商店")
KW_STATUS = ("状态", "status")
KW_MARK = ("订单标记", "标记", "mark")
KW_CLEAN_AMOUNT = ("买家实付", "实付", "金额", "付款")
KW_ORDER_ID = ("订单号", "订单编号", "order")
KW_SHOP = ("店铺", "shop")
KW_PRODUCT_KEY = ("商家编码", "sku", "编号", "商品编码", "货号", "code")
KW_ORDER_KEY = ("商品编码", "sku", "编号", "商家编码", "货号", "code")
KW_COST = ("成本", "进货", "采购", "cost")
KW_QUANTITY = ("数量", "件数", "qty", "num", "购买数量", "下单数量", "宝贝总数量")
KW_REVENUE = ("买家实付", "实付", "付款", "应付", "支付", "金额", "收款", "成交价", "支付金额")
KW_DUP_FIELDS = ("订单号", "商品编码", "商家编码", "sku")
KW_DEDUP_SKU = ("商品编码", "商家编码", "sku", "货号")
KW_DEDUP_SPEC = ("规格", "spec", "型号")

# ---------------------------------------------------------------------------
# FIXED VALUES: status texts and markers
# ---------------------------------------------------------------------------
STATUS_CLOSED = "关闭"
STATUS_OFFLINE = "[线下订单]"
STATUS_REFUND_FRAGMENT = "退款"
MARK_EMPTY_ORDER_FRAGMENT = "空单"

# ---------------------------------------------------------------------------
# FIXED VALUES: file-role name fragments (file catalogue)
# ---------------------------------------------------------------------------
FILE_ROLE_PRODUCT = "产品信息"
FILE_ROLE_ORDER = "订单"
FILE_ROLE_BILL = "账单"

# ---------------------------------------------------------------------------
# FIXED VALUES: headers of the fixed-schema (V1) export
# ---------------------------------------------------------------------------
V1_PRODUCT_KEY = "商家编码"
V1_PRODUCT_COLUMNS = ("商家编码", "商品", "SKU", "成本", "实际价格", "一口价")
V1_ORDER_KEY = "商品编码"
V1_ORDER_ID = "订单号"
V1_SHOP = "店铺名称"
V1_PRODUCT_NAME = "商品名称"
V1_PAID = "买家实付"
V1_ONLINE_STATUS = "线上订单状态"
V1_DETAIL_STATUS = "明细状态"
V1_COST = "成本"
V1_ACTUAL_PRICE = "实际价格"

# ---------------------------------------------------------------------------
# FIXED VALUES: match-status labels when the key search cannot match
# ---------------------------------------------------------------------------
MATCH_NO_CANDIDATES = "未匹配"
MATCH_ALL_FAILED = "匹配失败"
# Our own per-row labels for runs where a key pair was found.
MATCH_MATCHED = "matched"
MATCH_UNMATCHED = "unmatched"

# Timestamp format of the processing stamp.
STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# ---------------------------------------------------------------------------
# The engine's own names: a row's place in its file (path, block start, row)
# ---------------------------------------------------------------------------
LINE_POSITION = "__line_position"
PRODUCT_POSITION = "__product_position"
