"""Event codes, steps, rules and input schemas."""

from __future__ import annotations

# Event names and their stored codes (1-63 pixel, from 64 theme feed).
PIXEL, THEME = 1, 2
EVENT_CODES: dict[int, dict[str, int]] = {
    PIXEL: {
        "page_viewed": 1,
        "collection_viewed": 2,
        "product_viewed": 3,
        "search_submitted": 4,
        "cart_viewed": 5,
        "product_added_to_cart": 6,
        "product_removed_from_cart": 7,
        "checkout_started": 8,
        "checkout_contact_info_submitted": 9,
        "checkout_address_info_submitted": 10,
        "checkout_shipping_info_submitted": 11,
        "payment_info_submitted": 12,
        "checkout_completed": 13,
        "clicked": 14,
        "form_submitted": 15,
    },
    THEME: {"identify": 64, "link_click": 65, "internal_search": 66},
}
PAGE, COLLECTION, PRODUCT, CART, CHECKOUT, PAYMENT, COMPLETED = 1, 2, 3, 6, 8, 12, 13
# Funnel steps and checkout stages with their event codes.
FUNNEL_STEPS = {1: 1, 2: 3, 3: 6, 4: 8, 5: 12, 6: 13}
CHECKOUT_STAGES = {2: 8, 3: 9, 4: 10, 5: 11, 6: 12, 7: 13}
FUNNEL_NAMES = {
    1: "Visited the store", 2: "Viewed a product", 3: "Added to cart", 4: "Started checkout",
    5: "Entered payment details", 6: "Completed the order",
}
STAGE_NAMES = {
    2: "Started checkout", 3: "Entered contact details", 4: "Entered address", 5: "Chose shipping",
    6: "Entered payment details", 7: "Completed the order",
}
DEVICE_NAMES = {0: "Unknown", 1: "Mobile", 2: "Desktop", 3: "Tablet", 4: "Bot"}

# Currencies that amounts may be in.
CURRENCIES = ("INR", "USD", "AED", "GBP", "EUR")
# What a campaign without tags is called.
NO_CAMPAIGN, GOOGLE_CLICK, FACEBOOK_CLICK, CAMPAIGN_NUMBER = "No campaign tag", "Google Ads (auto-tagged)", "Facebook link (fbclid)", "Campaign #"

MODELS = ("pixel_first", "pixel_last", "shopify_first", "shopify_last")
DIRECT, OTHER = "Direct/Untracked", "Other"
COHORT_DAYS = (30, 60, 90, 180)
RECLOSE_DAYS, GRACE_HOURS, LOOKBACK_DAYS, SESSION_GAP_SECONDS = 3, 2, 30, 1800

# The default channel rules (priority, field, operator, value, channel).
DEFAULT_RULES: tuple[tuple[int, str, str, str | None, str], ...] = (
    (10, "utm_source", "contains", "instagram", "Instagram"),
    (11, "utm_source", "contains", "facebook", "Facebook"),
    (12, "utm_source", "contains", "fb", "Facebook"),
    (13, "utm_source", "contains", "google", "Google Ads"),
    (14, "utm_source", "contains", "youtube", "YouTube"),
    (15, "utm_source", "contains", "whatsapp", "WhatsApp"),
    (16, "utm_source", "contains", "klaviyo", "Email"),
    (17, "utm_source", "contains", "email", "Email"),
    (18, "utm_source", "contains", "sms", "SMS"),
    (19, "utm_source", "contains", "influencer", "Influencer"),
    (40, "utm_medium", "contains", "cpc", "Paid Search"),
    (41, "utm_medium", "contains", "paid", "Paid Social"),
    (42, "utm_medium", "contains", "email", "Email"),
    (43, "utm_medium", "contains", "affiliate", "Affiliate"),
    (44, "utm_medium", "contains", "organic", "Organic Search"),
    (50, "has_gclid", "exists", None, "Google Ads"),
    (51, "has_fbclid", "exists", None, "Facebook"),
    (60, "referrer_host", "contains", "instagram", "Instagram"),
    (61, "referrer_host", "contains", "facebook", "Facebook"),
    (62, "referrer_host", "contains", "l.facebook", "Facebook"),
    (63, "referrer_host", "contains", "google", "Organic Search"),
    (64, "referrer_host", "contains", "bing", "Organic Search"),
    (65, "referrer_host", "contains", "duckduckgo", "Organic Search"),
    (66, "referrer_host", "contains", "youtube", "YouTube"),
    (67, "referrer_host", "contains", "pinterest", "Pinterest"),
    (68, "referrer_host", "contains", "whatsapp", "WhatsApp"),
    (69, "referrer_host", "contains", "linkedin", "LinkedIn"),
    (99, "utm_source", "equals", None, DIRECT),
)

RAW_EVENTS = (
    "n STRING, s INT, id STRING, ts STRING, cid STRING, u STRING, r STRING, cu STRING, p STRING, v STRING, q STRING, "
    "a STRING, c STRING, ct STRING, o STRING, st STRING, cl STRUCT<t: STRING, s: STRING, h: STRING>, "
    "_t INT, _ip STRING, _ua STRING, _rx BIGINT, _corrupt STRING"
)
MONEY = "STRUCT<shopMoney: STRUCT<amount: STRING>>"
VISIT = (
    "STRUCT<landingPage: STRING, referrerUrl: STRING, occurredAt: STRING, utmParameters: "
    "STRUCT<source: STRING, medium: STRING, campaign: STRING, content: STRING, term: STRING>>"
)
RAW_ORDERS = (
    "tenant_id INT, id STRING, createdAt STRING, updatedAt STRING, cancelledAt STRING, displayFinancialStatus STRING, "
    "currencyCode STRING, customer STRUCT<id: STRING>, email STRING, phone STRING, sourceName STRING, landingSite STRING, "
    f"referringSite STRING, discountCodes ARRAY<STRING>, subtotalPriceSet {MONEY}, totalPriceSet {MONEY}, "
    f"totalDiscountsSet {MONEY}, totalRefundedSet {MONEY}, "
    "lineItems STRUCT<nodes: ARRAY<STRUCT<id: STRING, title: STRING, sku: STRING, quantity: INT, product: STRUCT<id: STRING>, "
    f"variant: STRUCT<id: STRING>, originalUnitPriceSet: {MONEY}, totalDiscountSet: {MONEY}>>>, "
    "customerJourneySummary STRUCT<ready: BOOLEAN, daysToConversion: INT, momentsCount: STRUCT<count: INT>, "
    f"firstVisit: {VISIT}, lastVisit: {VISIT}>"
)
