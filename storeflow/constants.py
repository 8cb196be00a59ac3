"""Fixed values that must equal the reference's for identical results.

FIXED VALUES (reference behavior; do not change):
"""

# --- catalog generation -------------------------------------------------
CATALOG_SIZE = 100000
BRANDS = ["Alpha", "Beta", "Gamma", "Delta", "Epsilon",
          "Zeta", "Eta", "Theta", "Iota", "Kappa"]
CATEGORIES = ["Electronics", "Books", "Home", "Sports",
              "Clothing", "Beauty", "Toys", "Automotive"]
CATEGORY_IDS = {"Electronics": 1, "Books": 2, "Home": 3, "Sports": 4,
                "Clothing": 5, "Beauty": 6, "Toys": 7, "Automotive": 8}
DEFAULT_CATEGORY_ID = 1
SKU_FORMAT = "SKU-%d"
NAME_FORMAT = "Product %s %d"
DESCRIPTION_FORMAT = "Description for product %d in %s category by %s"
WEIGHT_BASE = 100
WEIGHT_MODULUS = 900

# --- search ---------------------------------------------------------------
DEFAULT_MAX_CHECK = 100
DEFAULT_MAX_RESULTS = 20
SEARCH_START_ID = 1
SEARCH_WRAP = 100000
LATENCY_LIMIT_MS = 2000.0
# Search terms of the search load test (with its repeats).
LOAD_SEARCH_TERMS = [
    "Alpha", "Beta", "Gamma", "Delta", "Epsilon",
    "Zeta", "Eta", "Theta", "Iota", "Kappa",
    "Electronics", "Books", "Home", "Sports",
    "Clothing", "Beauty", "Toys", "Automotive",
    "Product", "Alpha", "Electronics", "Book",
    "electronics", "ALPHA", "beta", "SPORTS",
]

# --- validation (rule order, byte limits, messages) ----------------------
MSG_PRODUCT_ID = "product_id must be at least 1"
MSG_SKU = "sku must be between 1 and 100 characters"
MSG_MANUFACTURER = "manufacturer must be between 1 and 200 characters"
MSG_CATEGORY_ID = "category_id must be at least 1"
MSG_WEIGHT = "weight must be at least 0"
MSG_SOME_OTHER_ID = "some_other_id must be at least 1"
MSG_NAME = "name must be between 1 and 200 characters"
MSG_CATEGORY = "category must be between 1 and 100 characters"
MSG_DESCRIPTION = "description must be at most 1000 characters"
MSG_BRAND = "brand must be between 1 and 100 characters"
MSG_ID_POSITIVE = "product_id must be a positive integer"

# --- error records (code, message, details) -------------------------------
ERR_INVALID_INPUT = "INVALID_INPUT"
ERR_NOT_FOUND = "NOT_FOUND"
ERR_SERVICE_UNAVAILABLE = "SERVICE_UNAVAILABLE"
ERR_NO_TOPIC = "SNS_NOT_CONFIGURED"
ERR_PUBLISH_FAILED = "PUBLISH_FAILED"
MSG_INVALID_ID = "Invalid product ID"
DETAILS_INVALID_ID = "Product ID must be a positive integer"
MSG_NOT_FOUND = "Product not found"
DETAILS_NOT_FOUND = "No product exists with the given ID"
MSG_INVALID_JSON = "Invalid JSON format"
MSG_ID_MISMATCH = "Product ID mismatch"
DETAILS_ID_MISMATCH = "Product ID in URL must match product ID in request body"
MSG_INVALID_DATA = "Invalid product data"
MSG_MISSING_QUERY = "Missing query parameter"
DETAILS_MISSING_QUERY = "Query parameter 'q' is required"
MSG_SEARCH_UNAVAILABLE = "Search service temporarily unavailable"
DETAILS_SEARCH_UNAVAILABLE = "Search operation exceeded acceptable latency"
MSG_INVALID_BODY = "Invalid request body"

# --- orders ----------------------------------------------------------------
STATUS_PENDING = "pending"
STATUS_PROCESSING = "processing"
STATUS_COMPLETED = "completed"
MSG_ORDER_SYNC = "Order processed successfully"
MSG_ORDER_ASYNC = "Order accepted for processing"
PAYMENT_SECONDS = 3.0
PAYMENT_SLOTS = 1

# --- queue (topic/queue settings) -------------------------------------------
MAX_MESSAGE_BYTES = 262144
RETENTION_SECONDS = 345600
VISIBILITY_TIMEOUT_SECONDS = 30
RECEIVE_BATCH = 10

# --- synthetic load (order and product traffic generators) ------------------
ORDER_ITEMS_MIN, ORDER_ITEMS_MAX = 1, 3
ORDER_PRODUCT_MIN, ORDER_PRODUCT_MAX = 1, 1000
ORDER_QTY_MIN, ORDER_QTY_MAX = 1, 5
ORDER_PRICE_CENTS_MIN, ORDER_PRICE_CENTS_MAX = 999, 19999
ORDER_CUSTOMER_MIN, ORDER_CUSTOMER_MAX = 1, 10000
# product traffic mix get:add:missing:invalid:health
TRAFFIC_WEIGHTS = [("get", 10), ("add", 3), ("missing", 1), ("invalid", 1), ("health", 1)]
TRAFFIC_ADD_ID_RANGE = (1, 100000)
TRAFFIC_MISSING_ID_RANGE = (900000, 999999)
TRAFFIC_INVALID_IDS = ["abc", "0", "-1", "999999999999999"]
TRAFFIC_MANUFACTURERS = ["Acme Corporation", "TechGear Inc", "Global Manufacturing",
                         "Premium Products Ltd", "Innovation Industries"]
TRAFFIC_CATEGORY_ID_RANGE = (1, 100)
TRAFFIC_WEIGHT_RANGE = (100, 5000)
TRAFFIC_OTHER_ID_RANGE = (1, 1000)
TRAFFIC_SKU_SUFFIX_RANGE = (100, 999)

# --- failure texts of the response checks ----------------------------------------
FAIL_SEARCH_STATUS = "Search failed with status %d"
FAIL_JSON = "JSON parsing failed"
FAIL_FIELDS = "Missing required fields in response"
FAIL_TOO_MANY = "Too many products returned: %d"
FAIL_TOTAL = "Invalid total_found: %d"
FAIL_ORDER_MESSAGE = "Missing order_id or message_id in response"
FAIL_ORDER_ID = "Missing order_id in response"
FAIL_NOT_202 = "Expected 202, got %d"
FAIL_JSON_RESPONSE = "Invalid JSON response"
FAIL_STATUS = "Got status code %d"
FAIL_STRUCTURE = "Invalid response structure"
FAIL_PRODUCT_MISSING = "Product not found"
FAIL_PRODUCT_ID = "Missing product_id in response"
FAIL_NOT_404 = "Expected 404, got %d"
FAIL_NOT_400 = "Expected 400, got %d"

# --- capacity scenarios (report) ------------------------------------------------
SCENARIO_WORKERS = [1, 5, 20, 100, 182]
PER_WORKER_RATE_ROUNDED = 0.33

# --- request percentiles reported by the load tool --------------------------------
PERCENTILES = [0.5, 0.66, 0.75, 0.8, 0.9, 0.95, 0.98, 0.99, 0.999, 1.0]
