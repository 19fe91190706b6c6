"""Declared schemas of the four datasets and of the result. All fields are nullable."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    ByteType,
    DateType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields):
    return StructType([StructField(name, dtype, True) for name, dtype in fields.items()])


# Field names, types and order of the input contract.
impression_struct = _struct(item_id=IntegerType(), is_order=BooleanType())
impressions_schema = _struct(
    dt=StringType(),
    ranking_id=StringType(),
    customer_id=IntegerType(),
    impressions=ArrayType(impression_struct),
)
clicks_schema = _struct(
    dt=StringType(),
    customer_id=IntegerType(),
    item_id=IntegerType(),
    click_time=TimestampType(),
)
add_to_carts_schema = _struct(
    dt=StringType(),
    customer_id=IntegerType(),
    config_id=IntegerType(),
    simple_id=IntegerType(),
    occurred_at=TimestampType(),
)
previous_orders_schema = _struct(
    order_date=DateType(),
    customer_id=IntegerType(),
    config_id=IntegerType(),
    simple_id=IntegerType(),
)
training_inputs_schema = _struct(
    dt=StringType(),
    ranking_id=StringType(),
    customer_id=IntegerType(),
    impression_item_id=IntegerType(),
    is_order=BooleanType(),
    actions=ArrayType(IntegerType()),
    action_types=ArrayType(ByteType()),
)


def wire_schema(schema: StructType) -> StructType:
    """The same columns as a CSV file can carry them: nested columns travel as JSON strings."""
    return StructType(
        [
            StructField(f.name, StringType() if isinstance(f.dataType, ArrayType) else f.dataType, True)
            for f in schema.fields
        ]
    )
