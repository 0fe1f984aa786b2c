"""Schemas of what is read from outside; none is inferred."""

from __future__ import annotations

RAW_TX = (
    "struct<hash:string,nonce:string,`from`:string,`to`:string,value:string,gas:string,gasPrice:string,maxFeePerGas:string,"
    "maxPriorityFeePerGas:string,input:string,type:string,transactionIndex:string>"
)
RAW_BLOCK = (
    "number string, hash string, parentHash string, timestamp string, gasUsed string, gasLimit string, baseFeePerGas string, size string, "
    "difficulty string, totalDifficulty string, nonce string, miner string, extraData string, stateRoot string, transactionsRoot string, "
    f"receiptsRoot string, transactions array<{RAW_TX}>"
)
RAW_LOG = "struct<address:string,topics:array<string>,data:string,logIndex:string,removed:boolean>"
RAW_RECEIPT = (
    "transactionHash string, blockNumber string, gasUsed string, status string, contractAddress string, "
    f"logs array<{RAW_LOG}>"
)
TRACE = "txHash string, blockNumber long, timestamp long, result string, error string"
CREATIONS = "address string, creation_tx string, block_number string, creator string"
BLOCK_LANDING = "number long, hash string, parent_hash string, timestamp long, gas_used long, transaction_count int, size long, base_fee_per_gas long"
#: A block with all that a node gives for it: receipts and call traces.
RAW_BUNDLE = (
    f"{RAW_BLOCK}, receipts array<struct<transactionHash:string,status:string,contractAddress:string,logs:array<{RAW_LOG}>>>, "
    "traces array<struct<txHash:string,result:string,error:string>>"
)
