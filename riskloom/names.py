"""Column names and controlled values of the order-item data contract.

Everything in this module is a FIXED VALUE: column names, labels, cutoffs and
vocabularies that results must carry exactly so tables stay interchangeable.
"""

# --- keys -----------------------------------------------------------------
ORDER = "Order_Id"
ITEM = "Order_Item_Id"
ORDER_TS = "order_date_DateOrders"
SHIP_TS = "shipping_date_DateOrders"
KEYS = (ORDER, ITEM, ORDER_TS)
CHRONOLOGY = (ORDER_TS, ORDER, ITEM)

# --- raw and silver layers ------------------------------------------------
INGEST_TS = "_ingest_timestamp"
SOURCE_FILE = "_source_file"
SILVER_TS = "_silver_processed_timestamp"
RAW_TIMESTAMP_PATTERN = "M/d/yyyy H:mm"
RAW_ENCODING = "iso-8859-1"

SILVER_INTEGERS = [
    "Days_for_shipping_real",
    "Days_for_shipment_scheduled",
    "Late_delivery_risk",
    "Category_Id",
    "Customer_Id",
    "Department_Id",
    "Order_Customer_Id",
    "Order_Id",
    "Order_Item_Cardprod_Id",
    "Order_Item_Id",
    "Order_Item_Quantity",
    "Product_Card_Id",
    "Product_Category_Id",
    "Product_Status",
]
SILVER_DOUBLES = [
    "Benefit_per_order",
    "Sales_per_customer",
    "Latitude",
    "Longitude",
    "Order_Item_Discount",
    "Order_Item_Discount_Rate",
    "Order_Item_Product_Price",
    "Order_Item_Profit_Ratio",
    "Sales",
    "Order_Item_Total",
    "Order_Profit_Per_Order",
    "Product_Price",
]
SILVER_TIMESTAMPS = [ORDER_TS, SHIP_TS]
SILVER_TEXT = [
    "Type",
    "Delivery_Status",
    "Category_Name",
    "Customer_City",
    "Customer_Country",
    "Customer_Email",
    "Customer_Fname",
    "Customer_Lname",
    "Customer_Password",
    "Customer_Segment",
    "Customer_State",
    "Customer_Street",
    "Customer_Zipcode",
    "Department_Name",
    "Market",
    "Order_City",
    "Order_Country",
    "Order_Region",
    "Order_State",
    "Order_Status",
    "Order_Zipcode",
    "Product_Description",
    "Product_Image",
    "Product_Name",
    "Shipping_Mode",
    "_source_file",
]
SILVER_WATCHED_GAPS = [
    "Product_Description",
    "Order_Zipcode",
    "Customer_Lname",
    "Customer_Zipcode",
    "order_date_DateOrders",
    "shipping_date_DateOrders",
]

# --- feature tables -------------------------------------------------------
TIME_FEATURES = [
    "order_year",
    "order_quarter",
    "order_month",
    "order_week_of_year",
    "order_day_of_month",
    "order_day_of_week",
    "order_hour",
    "order_is_weekend",
    "order_season",
]
SHIPPING_PRODUCT_FEATURES = [
    "scheduled_shipping_days",
    "shipping_speed_tier",
    "shipping_mode_normalized",
    "is_same_day_or_next_day_shipping",
    "is_standard_shipping",
    "product_category_key",
    "product_department_key",
    "product_catalog_key",
    "product_name_normalized",
    "product_status_flag",
    "product_list_price",
    "order_item_quantity",
    "item_unit_price",
    "item_discount_amount",
    "item_discount_rate",
    "item_gross_sales_estimate",
    "item_net_sales_amount",
    "item_discount_share_of_gross",
]
CUSTOMER_REGIONAL_FEATURES = [
    "customer_segment_normalized",
    "customer_country_normalized",
    "customer_state_normalized",
    "customer_city_normalized",
    "customer_zipcode_available",
    "market_normalized",
    "order_country_normalized",
    "order_region_normalized",
    "order_state_normalized",
    "order_city_normalized",
    "order_zipcode_available",
    "customer_region_key",
    "order_region_key",
    "customer_order_country_match",
    "customer_order_state_match",
    "latitude_rounded",
    "longitude_rounded",
    "geo_coordinates_available",
]
SEASONS = ("fall", "spring", "summer", "winter")
SPEED_TIERS = ("economy", "expedited", "standard")

# --- modelling tables -----------------------------------------------------
LATE = "Late_delivery_risk"
PROFIT = "Order_Profit_Per_Order"
ROW_NUMBER = "chronological_row_number"
SPLIT = "split_partition"
DEVELOPMENT, TEST, TRAIN, VALIDATION = "development", "test", "train", "validation"
INNER_TRAIN, INNER_VALIDATION = "development_inner_train", "development_inner_validation"
DEVELOPMENT_RATIO = 0.80
INNER_VALIDATION_RATIO = 0.20

CANCELLED_DELIVERY = "Shipping canceled"
EXCLUDED_ORDER_STATUS = ("CANCELED", "SUSPECTED_FRAUD")

_SHARED_SHIPPING = SHIPPING_PRODUCT_FEATURES[:7]
_SHARED_REGIONAL = [
    "customer_segment_normalized",
    "customer_country_normalized",
    "customer_state_normalized",
    "customer_zipcode_available",
    "market_normalized",
    "order_country_normalized",
    "order_region_normalized",
    "order_state_normalized",
    "order_zipcode_available",
    "customer_order_country_match",
    "customer_order_state_match",
    "geo_coordinates_available",
]
LATE_PREDICTORS = ["Type", *TIME_FEATURES, *_SHARED_SHIPPING, *_SHARED_REGIONAL]
PROFIT_PREDICTORS = [
    "Type", *TIME_FEATURES, *_SHARED_SHIPPING,
    "item_unit_price", "item_discount_rate", "order_item_quantity", *_SHARED_REGIONAL,
]
ORDER_VALUE = "ao3_order_value"

LATE_NUMERIC = [
    "order_year",
    "order_quarter",
    "order_month",
    "order_week_of_year",
    "order_day_of_month",
    "order_day_of_week",
    "order_hour",
    "scheduled_shipping_days",
]
PROFIT_NUMERIC = LATE_NUMERIC + ["item_unit_price", "item_discount_rate", "order_item_quantity"]
BINARY_FEATURES = [
    "order_is_weekend",
    "is_same_day_or_next_day_shipping",
    "is_standard_shipping",
    "customer_zipcode_available",
    "order_zipcode_available",
    "customer_order_country_match",
    "customer_order_state_match",
    "geo_coordinates_available",
]
CATEGORICAL_FEATURES = [
    "Type",
    "order_season",
    "shipping_speed_tier",
    "shipping_mode_normalized",
    "product_category_key",
    "product_department_key",
    "customer_segment_normalized",
    "customer_country_normalized",
    "customer_state_normalized",
    "market_normalized",
    "order_country_normalized",
    "order_region_normalized",
    "order_state_normalized",
]

# Realized outcomes that must never reach a served table.
SERVED_FORBIDDEN = (
    "Late_delivery_risk", "Order_Profit_Per_Order", "Delivery_Status",
    "Days_for_shipping_real", "Order_Item_Profit_Ratio", "Benefit_per_order",
)
# Outcomes, identifiers and high-cardinality fields kept out of the modelling tables.
GOLD_FORBIDDEN_SHARED = [
    "Delivery_Status",
    "Days_for_shipping_real",
    "shipping_date_DateOrders",
    "Order_Status",
    "Benefit_per_order",
    "Order_Item_Profit_Ratio",
    "Sales",
    "Sales_per_customer",
    "Order_Item_Total",
    "Product_Image",
    "Product_Description",
    "Customer_Email",
    "Customer_Fname",
    "Customer_Lname",
    "Customer_Password",
    "Customer_Street",
    "Customer_Id",
    "Order_Customer_Id",
    "Customer_City",
    "Order_City",
    "Customer_Zipcode",
    "Order_Zipcode",
    "Latitude",
    "Longitude",
    "Product_Card_Id",
    "Order_Item_Cardprod_Id",
    "Product_Category_Id",
    "Product_Name",
    "product_catalog_key",
    "product_name_normalized",
    "product_status_flag",
    "product_list_price",
    "item_discount_amount",
    "item_gross_sales_estimate",
    "item_net_sales_amount",
    "item_discount_share_of_gross",
    "customer_city_normalized",
    "order_city_normalized",
    "customer_region_key",
    "order_region_key",
    "latitude_rounded",
    "longitude_rounded",
]
LATE_GOLD_FORBIDDEN = GOLD_FORBIDDEN_SHARED + [PROFIT, "item_unit_price", "item_discount_rate"]
PROFIT_GOLD_FORBIDDEN = GOLD_FORBIDDEN_SHARED + ["Product_Price"]

# --- scores, policy, segments ---------------------------------------------
RISK = "ao1_predicted_late_delivery_probability"
HIGH_RISK = "ao1_high_risk_flag"
EXPECTED_PROFIT = "ao2_predicted_order_profit"
MARGIN = "ao3_predicted_margin"
HIGH_MARGIN = "ao3_high_margin_flag"
SEGMENT = "ao3_priority_segment"
RISK_CUTOFF = 0.35
MARGIN_CUTOFF = 0.0
PROTECT = "protect_high_value_at_risk"
EXPEDITE = "expedite_selectively"
PRESERVE = "preserve_service"
STANDARD = "standard_process"
SCORE_REVIEW = "requires_score_review"
MARGIN_REVIEW = "requires_margin_review"
SEGMENTS = (EXPEDITE, PRESERVE, PROTECT, MARGIN_REVIEW, SCORE_REVIEW, STANDARD)
OPERATIONAL_SEGMENTS = (PROTECT, EXPEDITE, PRESERVE, STANDARD)
POLICY_NAME = "ao3_risk_margin_matrix"

THRESHOLD_GRID = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
MIN_RECALL, MAX_ALERT_RATE = 0.70, 0.65

PROFIT_BAND_EDGES = (0, 10, 25, 50, 100)
PROFIT_BANDS_DASH = (
    "Negative Profit", "$0 - $10", "$10 - $25", "$25 - $50", "$50 - $100", "$100+",
)
PROFIT_BANDS_TO = (
    "Negative Profit", "$0 to $10", "$10 to $25", "$25 to $50", "$50 to $100", "$100+",
)
RISK_BANDS = ("Low Risk", "Medium Risk", "High Risk")
RISK_BAND_EDGES = (0.35, 0.65)

# --- profiling ------------------------------------------------------------
MIN_SUPPORT_FLOOR, MIN_SUPPORT_FRACTION = 100, 0.005
MAX_DIRECT_LEVELS = 75
